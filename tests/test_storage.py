import json
import random
from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from graphs import TINY, graph_of, hub_edges
from hopline.functions.text import round_stat
from hopline.model import EDGE_SCHEMA
from hopline.operators import checks, paths, pattern, traverse
from hopline.plans.lineage import settle, shared_dir
from hopline.plans.limits import Limits
from hopline.plans.session import PARTITION_BYTES, recommended_settings
from hopline.sources import results, tables
from hopline.streaming.append import append_arrivals


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def test_materialise_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.materialise(spark.range(10), path)
    assert tables.materialise(spark.range(3), path).count() == 3


def test_clustered_files_skip_and_split_a_hub(spark, tmp_path):
    graph = graph_of(spark, range(30), hub_edges(2) + [(1, 2, "a", 7)] * 300)
    source = tables.materialise(graph.edges.repartition(6), str(tmp_path / "raw"))
    path = str(tmp_path / "clustered")
    got = tables.materialise_clustered(source, path, ["src", "dst", "edge_type", "ts"], files=6)
    assert bag(got) == bag(graph.edges)
    per_file = got.groupBy(F.input_file_name().alias("f")).count().collect()
    total = sum(r["count"] for r in per_file)
    assert len(per_file) >= 5 and max(r["count"] for r in per_file) < total / 2
    plan = got.where(F.col("src").isin(3, 4))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(src, [3,4])]" in plan


def test_window_opens_only_its_periods(spark, tmp_path):
    path = str(tmp_path / "periods")
    graph = graph_of(spark, [1], [(1, i, "a", i * 10) for i in range(-5, 50)])
    tables.materialise_by_period(graph.edges, path, 100)
    got = tables.read_window(spark, path, 100, -20, 210)
    assert bag(got) == sorted((1, i, "a", i * 10) for i in range(-2, 22))
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(period" in plan


def test_redelivered_batches_collapse(spark, tmp_path):
    path = str(tmp_path / "appended")
    graph = graph_of(spark, [1, 2], [(1, 2, "a", 1), (2, 1, "a", 2)])
    for _ in range(3):
        tables.append(graph.edges, path)
    keys = ["src", "dst", "edge_type"]
    got = tables.latest_per_key(tables.read_edges(spark, path), keys, "ts")
    assert bag(got) == [(1, 2, "a", 1), (2, 1, "a", 2)]


def test_arrivals_are_loaded_once(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    first = graph_of(spark, [1], [(1, i) for i in range(40)]).edges.repartition(5)
    tables.append(first, source)
    assert append_arrivals(spark, source, EDGE_SCHEMA, target, progress, 2).count() == 40
    tables.append(graph_of(spark, [1], [(2, i) for i in range(7)]).edges, source)
    assert append_arrivals(spark, source, EDGE_SCHEMA, target, progress, 2).count() == 47


def test_result_documents(spark, tmp_path):
    stats = {"min_ms": 1.0, "median_ms": 2.0, "p95_ms": 3.0, "max_ms": 4.0, "iters": 20}
    documents = {
        "alpha_small": {
            "db": "alpha", "size": "small", "ingest": {"ingest_ms": 12.5},
            "queries": {"hop": stats, "path": {"error": "no"}, "_errors": {"path": "no" * 90}},
        },
        "vec_alpha_small": {
            "db": "vec_alpha", "size": "small", "ingest": {"ingest_ms": 7.0},
            "index_build": {"build_ms": 80.25}, "queries": {"knn": stats},
        },
        "vec_alpha_large": {"db": "vec_alpha", "size": "large", "skipped": True, "reason": "slow"},
        "readme": {"db": "none"},
    }
    for stem, document in documents.items():
        (tmp_path / f"{stem}.json").write_text(json.dumps(document, indent=2))
    read = results.read_documents(spark, str(tmp_path))
    got = {(r.engine, r["size"]): r for r in read.collect()}
    assert set(got) == {("alpha", "small"), ("vec_alpha", "small"), ("vec_alpha", "large")}
    assert got["vec_alpha", "small"].build_ms == 80.25 and got["alpha", "small"].ingest_ms == 12.5
    assert got["vec_alpha", "large"].skipped and got["vec_alpha", "large"].reason == "slow"
    rows = {(r.engine, r.query): r for r in results.query_stats(read).collect()}
    assert set(rows) == {("alpha", "hop"), ("alpha", "path"), ("vec_alpha", "knn")}
    assert rows["alpha", "hop"].median_ms == 2.0 and rows["alpha", "hop"].iters == 20
    assert rows["alpha", "path"].median_ms is None and rows["alpha", "path"].error == "no"
    errors = results.error_messages(read).collect()
    assert [(e.engine, e.query, e.message) for e in errors] == [("alpha", "path", "no" * 90)]


def test_documents_of_similar_names_stay_apart(spark, tmp_path):
    rows = [("a_b", "c"), ("a", "b_c"), ("a%b", "c"), ("a b", "s:1"), ("a%5Fb", "c")]
    stats = [(e, s, "hop", 1.0, 2.0, 3.0, float(i), 5) for i, (e, s) in enumerate(rows)]
    names = "engine string, size string, query string, min_ms double, median_ms double, p95_ms double, max_ms double, iters long"
    results.write_results(spark.createDataFrame(stats, names), str(tmp_path / "r"))
    read = results.query_stats(results.read_documents(spark, str(tmp_path / "r")))
    got = {(r.engine, r["size"]): r.max_ms for r in read.collect()}
    assert got == {name: float(i) for i, name in enumerate(rows)}


def test_settle_knows_the_size(spark):
    few = settle(spark.range(3).withColumnRenamed("id", "node"), Limits(literal_rows=5))
    assert few.rows == 3 and few.literals("node") == [0, 1, 2]
    many = settle(spark.range(30).withColumnRenamed("id", "node"), Limits(literal_rows=5))
    assert many.rows == 30 and many.literals("node") is None


def test_scratch_is_in_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or shared_dir(spark) == configured


def files_below(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_writes_the_touched_buckets_only(spark, tmp_path):
    rows = lambda ids, seq: spark.createDataFrame([(i, seq, f"v{seq}") for i in ids], "id long, seq long, v string")
    path = str(tmp_path / "t")
    assert tables.upsert(rows(range(1_000), 1), path, ["id"], "seq", buckets=50).count() == 1_000
    before = files_below(tmp_path / "t" / "version=1")
    batch = rows(range(0, 1_000, 100), 2)  # one percent of the keys
    got = tables.upsert(batch, path, ["id"], "seq")
    wanted = {r.b for r in batch.selectExpr("pmod(xxhash64(id), 50) as b").collect()}
    written = {int(p.name[7:]) for p in (tmp_path / "t" / "version=2").glob("bucket=*")}
    assert written == wanted and len(written) <= 10
    assert files_below(tmp_path / "t" / "version=1") == before  # nothing else was written again
    assert bag(got.groupBy("v").count()) == [("v1", 990), ("v2", 10)]
    # delivered again, and late: nothing changes
    want = bag(got)
    assert bag(tables.upsert(batch, path, ["id"], "seq")) == want
    assert bag(tables.upsert(rows(range(0, 1_000, 100), 1), path, ["id"], "seq")) == want
    # folders that no kept version uses are gone
    assert not [b for b in wanted if (tmp_path / "t" / "version=2" / f"bucket={b}").exists()]


def test_upsert_deals_rows_out_once(spark, tmp_path, monkeypatch):
    """Small tasks and a key with very many versions, nulls in keys and sequence, against a loop."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    plain, combined = tables._by_bucket, []
    plans = []

    def spied(*args):
        newest = plain(*args)
        plans.append(newest._jdf.queryExecution().executedPlan().toString())
        return newest

    monkeypatch.setattr(tables, "_by_bucket", spied)
    whole = tables.latest_per_key
    monkeypatch.setattr(tables, "latest_per_key", lambda df, *a: combined.append(df.count()) or whole(df, *a))
    rng = random.Random(4)
    some = lambda n, of: [None if rng.random() < 0.05 else rng.randrange(of) for _ in range(n)]
    given = list(zip(some(3_000, 400), some(3_000, 3), some(3_000, 50), some(3_000, 9)))
    given += [(7, 1, s, 0) for s in range(900)]  # one key, many versions
    schema, path = "a long, b long, seq long, v long", str(tmp_path / "t")
    low = lambda x: (x is not None, x or 0)
    best = {}
    for half in (given[::2], given[1::2], given[::2]):
        got = tables.upsert(spark.createDataFrame(half, schema).repartition(3), path, ["a", "b"], "seq", buckets=5)
        for r in half:
            if r[:2] not in best or [low(x) for x in r[2:]] > [low(x) for x in best[r[:2]][2:]]:
                best[r[:2]] = r
        assert sorted(map(tuple, got.collect()), key=str) == sorted(best.values(), key=str)
    assert len(combined) == 3 and all(450 <= n < 1_000 for n in combined)
    # without a key of many versions: one shuffle, no hash table of keys, one sort
    plans.clear()
    tables.upsert(spark.createDataFrame([(i, 0, 0, 0) for i in range(3_000)], schema), path, ["a", "b"], "seq")
    assert plans[0].count("Exchange") == 1 and "HashAggregate" not in plans[0] and plans[0].count("Sort [") == 1


def test_upsert_that_failed_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert(spark.createDataFrame([(1, 1)], "id long, seq long"), path, ["id"], "seq", buckets=4)
    (tmp_path / "t" / "version=2" / "bucket=0").mkdir(parents=True)  # data, but no manifest
    assert bag(tables.read_stored(spark, path)) == [(1, 1)]
    assert bag(tables.upsert(spark.createDataFrame([(2, 1)], "id long, seq long"), path, ["id"], "seq")) == [(1, 1), (2, 1)]


def test_upsert_of_nothing(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.createDataFrame([], "id long, seq long")
    assert tables.upsert(none, path, ["id"], "seq").count() == 0
    assert bag(tables.upsert(spark.createDataFrame([(1, 1)], "id long, seq long"), path, ["id"], "seq")) == [(1, 1)]
    assert bag(tables.upsert(none, path, ["id"], "seq")) == [(1, 1)]


def files_read(df):
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_a_graph_stored_by_both_ends(spark, tmp_path):
    edges = hub_edges(2) + [(n, 100 + n, "c", n) for n in range(-20, 30)]
    graph = graph_of(spark, [*range(-20, 130)], edges, endpoints_ok=True)
    stored = tables.store_graph(graph, str(tmp_path), buckets=11)
    assert bag(stored.edges) == bag(graph.edges) and stored.endpoints_ok
    opened = tables.open_graph(spark, str(tmp_path))
    assert bag(opened.reversed().edges) == bag(graph.reversed().edges)
    # a hop from a few nodes, either way, scans the folders of their buckets
    for g, key in ((opened, "src"), (opened.reversed(), "src"), (opened, "dst")):
        near = g.edges_at(key, [2, -20])
        assert bag(near) == bag(g.edges.where(F.col(key).isin(2, -20)))
        plan = near._jdf.queryExecution().toString()
        assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        scan = near._jdf.queryExecution().executedPlan()
        near.collect()
        assert files_read(near) <= 2 * len(list((tmp_path / "by_src").glob("bucket=2/*.parquet"))) + 2 < files_read(g.edges)
        assert scan is not None
    for node in (2, 105):
        assert bag(traverse.walk_rows(opened.reversed(), node, 2)) == bag(traverse.walk_rows(graph.reversed(), node, 2))
    window = traverse.time_slice(opened, 10, 60)
    assert bag(window.reversed().edges_at("src", [2])) == bag(window.reversed().edges.where("src = 2"))
    want = bag(pattern.triples(graph, "x", 50))
    assert bag(pattern.triples(opened, "x", 50)) == want
    route = [r.node for r in paths.shortest_route(opened, 1, 102).orderBy("step").collect()]
    assert route == [r.node for r in paths.shortest_route(graph, 1, 102).orderBy("step").collect()]


def test_a_graph_without_manifest_is_none(spark, tmp_path):
    graph = graph_of(spark, [1, 2], [(1, 2)])
    tables.store_graph(graph, str(tmp_path))
    tables._delete(spark, f"{tmp_path}/{tables.MANIFEST}")
    with pytest.raises(AnalysisException):
        tables.open_graph(spark, str(tmp_path))


def test_one_layout_skips_by_source_and_by_time(spark, tmp_path):
    """Row groups that can hold edges of a source in a window, of all row groups."""
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200), "a", rng.randrange(10_000)) for _ in range(6_000)]
    edges += [(7, 8, "a", 5)] * 900 + [(9, n, "b", 10 * n) for n in range(900)] + [(None, 1, "a", None)]
    graph = graph_of(spark, range(200), edges, endpoints_ok=True)
    path = str(tmp_path / "curve")
    stored = tables.materialise_by_curve(graph.edges.repartition(4), path, files=64, bits=5)
    assert bag(stored.na.fill(-1)) == bag(graph.edges.na.fill(-1))
    groups = []
    for file in (tmp_path / "curve").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.schema.column(c).name: meta.row_group(g).column(c).statistics for c in range(4)}
            groups.append([(s.min, s.max) if s.has_min_max else (1, 0) for s in (columns["src"], columns["ts"])])
    within = lambda lo, hi, bounds: bounds[0] <= hi and lo <= bounds[1]
    both = [sum(within(s, s, src) and within(t, t + 500, ts) for src, ts in groups) / len(groups) for s in (3, 50, 120, 9) for t in (1_000, 8_000)]
    by_source = sum(within(50, 50, src) for src, _ in groups) / len(groups)
    by_time = sum(within(1_000, 1_500, ts) for _, ts in groups) / len(groups)
    assert len(groups) >= 40 and max(both) < 0.15 and by_source < 0.5 and by_time < 0.5
    window = traverse.time_slice(graph.with_edges(tables.read_edges(spark, path)), 1_000, 1_500)
    plan = window.edges_at("src", [50])._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "ts" in pushed and "src" in pushed
    assert bag(window.edges_at("src", [9])) == bag(graph.edges.where("src = 9 and ts between 1000 and 1500"))


def test_a_curve_takes_odd_rows_and_its_bounds_part_all_rows_evenly(spark, tmp_path):
    """Also where a column has no values, few or infinite ones, and over more columns than a long has bits for."""
    inf, nan = float("inf"), float("nan")
    rows = [(inf, 1.0), (-inf, 2.0), (nan, 3.0), (None, 4.0), (1.0, None), (1.0, None), (None, None)]
    odd = {
        "empty": spark.createDataFrame([], "src long, ts long"),
        "nulls": spark.createDataFrame([(None, None)] * 3, "src long, ts long"),
        "same": spark.createDataFrame([(5, 5)] * 3, "src long, ts long"),
        "floats": spark.createDataFrame(rows, "src double, ts double"),
    }
    for name, given in odd.items():
        stored = tables.materialise_by_curve(given, str(tmp_path / name))
        assert sorted(map(str, stored.collect())) == sorted(map(str, given.collect()))
    few = [(s, t) for s in (1, 2) for t in range(3_000)]
    few = spark.createDataFrame(few, "src long, ts long").repartition(4)
    for columns in (("src", "ts"), ("src", "ts", "far"), ("src", "ts", "far", "wide", "low", "a", "b", "c")):
        given = few.selectExpr("*", "-ts * ts far", "src + ts wide", "ts % 7 low", "1 a", "ts b", "-ts c")
        stored = tables.materialise_by_curve(given, str(tmp_path / str(len(columns))), columns)
        assert sorted(map(str, stored.collect())) == sorted(map(str, given.collect()))
    shares = tables._shares(spark.range(100_000).selectExpr("id", "id % 10 low", "null none"), ["id", "low", "none"], 64)
    assert all(abs(x - 100_000 * i / 64) < 3 * 100_000 / 64 for i, x in enumerate(shares[0], 1))
    assert sorted(set(shares[1])) == list(range(10)) and shares[2] == []


def test_places_on_a_curve_rise_with_each_column():
    """In a sort key, narrower stretches follow the curve's; no two pairs of them share a key."""
    for bits, finer in ((2, 2), (3, 0)):
        parts = 2 ** (bits + finer) + 1
        src, ts = ([tables._curve(s, i, 2, bits, finer) for s in range(parts)] for i in range(2))
        keys = {(s, t): src[s] + ts[t] for s in range(parts) for t in range(parts)}
        assert len(set(keys.values())) == parts**2
        for s, t in keys:
            assert s == 0 or keys[s - 1, t] < keys[s, t]
            assert t == 0 or keys[s, t - 1] < keys[s, t]
        turns = sorted(keys, key=keys.get)
        cells = [(s >> finer, t >> finer) for s, t in turns]
        assert sum(a != b for a, b in zip(cells, cells[1:])) + 1 == len(set(cells))


def test_errors_are_read_from_both_places(spark, tmp_path):
    documents = {
        "a_small.json": {"queries": {"q1": {"min_ms": 1.0}, "q2": {"error": "short"}, "q3": {"error": "lost"}, "_errors": {"q2": "the whole story"}}},
        "vec_a_small.json": {"queries": {"q1": {"error": "no"}}},
        "b_small.json": {"skipped": True, "reason": "too large"},
    }
    for name, document in documents.items():
        (tmp_path / name).write_text(json.dumps(document))
    read = results.read_documents(spark, str(tmp_path))
    assert bag(results.error_messages(read)) == [("a", "small", "q2", "the whole story"), ("a", "small", "q3", "lost"), ("vec_a", "small", "q1", "no")]
    assert bag(results.skipped_runs(read)) == [("b", "small", "too large")]
    assert {r.engine for r in results.graph_documents(read).collect()} == {"a", "b"}
    assert {r.engine for r in results.vector_documents(read).collect()} == {"a"}


def test_rounding_is_of_the_decimal_form(spark):
    """Ties go away from zero on the digits a number is written with, not on its binary value."""
    given = spark.createDataFrame([(0.125,), (2.675,), (-0.125,), (1.005,)], "x double")
    assert [r.r for r in given.select(round_stat(F.col("x"), 2).alias("r")).collect()] == [0.13, 2.68, -0.13, 1.01]


def test_a_batch_is_checked_against_stored_keys(spark, tmp_path):
    rng = random.Random(4)
    keys = ["src", "dst", "edge_type"]
    old = [(rng.randrange(300), rng.randrange(300), "a", n) for n in range(2_000)]
    batch = [*[(s, d, t, 9_000) for s, d, t, _ in old[:5]], (1_000, 1, "a", 1), (1_001, 1, "a", 1), (1_001, 1, "a", 2), (None, 7, "a", 1)]
    graph = tables.store_graph(graph_of(spark, range(300), old, endpoints_ok=True), str(tmp_path / "g"), buckets=31)
    checks.store_key_filter(graph.edges, str(tmp_path / "f"), keys)
    known = checks.open_key_filter(spark, str(tmp_path / "f"))
    assert bag(known.may_hold(graph.edges)) == bag(graph.edges.select(*keys).distinct())
    fresh = spark.range(20_000).selectExpr("id + 5000 as src", "id as dst", "'a' as edge_type")
    assert known.may_hold(fresh).count() <= 60  # about one in 2,000
    arrived = spark.createDataFrame(batch, EDGE_SCHEMA)
    whole = checks.key_violations(graph.edges.unionByName(arrived), keys)
    whole = whole.join(arrived, [whole[k].eqNullSafe(arrived[k]) for k in keys], "left_semi")
    want = sorted(map(tuple, whole.collect()), key=str)
    for g in (graph, replace(graph, limits=TINY)):
        got = checks.batch_key_violations(g, known, arrived)
        assert sorted(map(tuple, got.collect()), key=str) == want
    # an added batch is known as well; adding it again changes nothing
    known.add(arrived).add(arrived)
    assert known.may_hold(arrived).count() == 8
    missing = bag(checks.batch_missing_endpoints(graph, arrived.where("src is not null")))
    assert missing == [("src", 1_000, 1), ("src", 1_001, 2)]


def test_a_key_is_moved_once_to_a_filter(spark, tmp_path):
    """One row per key goes to the filter, and one to be compared with it, not one per hash."""
    rows = spark.range(1_000).selectExpr("id as src", "if(id % 2 = 0, id, null) as dst", "'a' as edge_type")
    for hashes in (7, 12):
        known = checks.store_key_filter(rows, str(tmp_path / str(hashes)), ["src", "dst", "edge_type"], hashes=hashes)
        plan = known.may_hold(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan
        assert known.may_hold(rows).count() == 1_000
        assert known.may_hold(rows.selectExpr("src + 5000 as src", "dst", "edge_type")).count() <= 10


def test_shuffle_width_follows_the_input():
    wide = recommended_settings(input_bytes=100 * 10**12)
    assert int(wide["spark.sql.shuffle.partitions"]) * PARTITION_BYTES >= 100 * 10**12
    assert recommended_settings(input_bytes=10)["spark.sql.shuffle.partitions"] == "200"
    assert "spark.sql.shuffle.partitions" not in recommended_settings()


def test_latest_rows_are_combined_in_tasks_of_bounded_size(spark, monkeypatch):
    """Nulls and a key of very many versions, against a loop; other rows move before they are combined."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    rng = random.Random(5)
    some = lambda n, of: [None if rng.random() < 0.05 else rng.randrange(of) for _ in range(n)]
    given = list(zip(some(2_000, 400), some(2_000, 3), some(2_000, 50), some(2_000, 9)))
    given += [(7, 1, s, 0) for s in range(900)]  # one key, many versions
    low = lambda x: (x is not None, x or 0)
    for width in (3, 4):
        best = {}
        for r in (r[:width] for r in given):
            if r[:2] not in best or [low(x) for x in r[2:]] > [low(x) for x in best[r[:2]][2:]]:
                best[r[:2]] = r
        rows = spark.createDataFrame(given, "a long, b long, seq long, v long").repartition(3)
        got = tables.latest_per_key(rows, ["a", "b"], "seq", ["a", "b", "seq", "v"][:width])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(best.values(), key=str)
    spread = spark.range(3_000).selectExpr("id AS a", "id % 7 AS seq")
    got = tables.latest_per_key(spread, ["a"], "seq")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("Aggregate") < plan.index("Exchange")
    assert got.rdd.getNumPartitions() == 30 and got.count() == 3_000
    assert tables.latest_per_key(spread.limit(0), ["a"], "seq").count() == 0
