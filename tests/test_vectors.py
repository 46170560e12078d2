import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hopline.functions.vectors import cosine_distance, l2_normalize, vector_literal
from hopline.operators import cells, checks, kernels, knn, radius
from hopline.plans.catalog import CATALOG
from hopline.plans.limits import Limits
from hopline.sources import tables

DIM = 8


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def random_rows(n, seed=0, dim=DIM):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.standard_normal(dim)]) for i in range(n)]


def brute(rows, query, k):
    q = np.asarray(query, dtype=np.float64)
    out = []
    for i, v in rows:
        if v is None or len(v) != len(q) or any(x is None for x in v):
            continue
        v = np.asarray(v, dtype=np.float32).astype(np.float64)
        if np.linalg.norm(v) > 0:
            d = 1 - v @ q / np.linalg.norm(v) / np.linalg.norm(q)
            out.append((round(float(d), 6) + 0.0, i))
    return [(i, d) for d, i in sorted(out)[:k]]


ODD = [(900, [0.0] * DIM), (901, [1.0] * (DIM - 1)), (902, None), (903, [None] + [1.0] * (DIM - 1))]


@pytest.fixture(scope="module")
def rows():
    # Copies of one vector tie with each other and are told apart by id.
    copies = [(500 + i, [1.0] + [0.0] * (DIM - 1)) for i in range(120)]
    return random_rows(240) + copies


def test_distance_of_odd_vectors_is_null(spark):
    df = corpus(spark, ODD + [(1, [2.0] + [0.0] * (DIM - 1))])
    q = vector_literal([1.0] + [0.0] * (DIM - 1))
    got = {r.id: r.d for r in df.select("id", cosine_distance(F.col("embedding"), q).alias("d")).collect()}
    assert got[1] == 0.0 and all(got[i] is None for i in (900, 901, 902, 903))


def test_normalise(spark):
    df = corpus(spark, [(1, [3.0, 4.0] + [0.0] * (DIM - 2)), (2, [0.0] * DIM)])
    got = {r.id: r.u for r in df.select("id", l2_normalize(F.col("embedding")).alias("u")).collect()}
    assert got[1][:2] == [0.6, 0.8] and got[2] is None


def test_nearest_ties_and_odd_rows(spark, rows):
    df = corpus(spark, rows + ODD).repartition(5)
    q = [1.0] + [0.0] * (DIM - 1)
    got = [(r.id, r.distance) for r in knn.nearest(df, q, 15).collect()]
    assert got == brute(rows, q, 15) and got[0] == (500, 0.0)


@pytest.mark.parametrize("limits", [Limits(), Limits(query_rows=5)])
def test_nearest_many(spark, rows, limits):
    df = corpus(spark, rows + ODD).repartition(5)
    asked = random_rows(17, seed=9) + [(50, [1.0] + [0.0] * (DIM - 1)), (51, [0.0] * DIM), (52, [1.0])]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    got = {}
    found = knn.nearest_many(df, queries, 7, DIM, limits=limits).orderBy("query_id", "rank")
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.id, r.distance))
    want = {
        i: brute(rows, np.asarray(v, dtype=np.float32), 7) for i, v in asked if len(v) == DIM and any(v)
    }
    assert got == want


def test_fewer_rows_than_k(spark):
    df = corpus(spark, random_rows(3))
    queries = spark.createDataFrame(random_rows(2, 1), "query_id long, query_vector array<float>")
    assert knn.nearest_many(df, queries, 10, DIM).count() == 6
    assert knn.nearest(df, [1.0] * DIM, 10).count() == 3


def test_repeated_query_ids_are_refused(spark):
    queries = spark.createDataFrame([(1, [1.0] * DIM)] * 300, "query_id long, query_vector array<float>")
    with pytest.raises(ValueError, match="not unique"):
        knn.nearest_many(corpus(spark, random_rows(3)), queries, 1, DIM, limits=Limits(query_rows=10))


def test_wrong_length(spark):
    df = corpus(spark, ODD)
    assert {r.id for r in checks.wrong_vectors(df, "embedding", DIM).collect()} == {901, 902}
    with pytest.raises(PySparkException, match="expected 8 elements, found 7"):
        tables.array_shape(df.where("id = 901"), "embedding", DIM).collect()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    return cells.build_cells(corpus(spark, rows + ODD).repartition(4), path, 6, DIM)


def test_every_id_is_in_one_cell(spark, rows, index):
    got = index.corpus(spark).select("id", "cell").collect()
    assert sorted(r.id for r in got) == sorted(i for i, _ in rows + ODD)
    assert {r.id for r in got if r.cell == cells.NO_CELL} == {i for i, _ in ODD}


def test_full_probe_equals_exact(spark, rows, index):
    q = random_rows(1, seed=4)[0][1]
    exact = knn.nearest(corpus(spark, rows), q, 10).collect()
    assert cells.nearest_in_cells(spark, index, q, 10, index.cells).collect() == exact
    queries = spark.createDataFrame(random_rows(9, 2), "query_id long, query_vector array<float>")
    want = knn.nearest_many(corpus(spark, rows), queries, 5, DIM)
    found = cells.nearest_many_in_cells(spark, index, queries, 5, index.cells, limits=Limits(query_rows=4))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert {r.recall for r in cells.recall(found, want).collect()} == {1.0}


def test_partial_probe_reads_few_cells_and_recall_grows(spark, rows, index):
    queries = spark.createDataFrame(random_rows(20, 3), "query_id long, query_vector array<float>")
    exact = knn.nearest_many(corpus(spark, rows), queries, 5, DIM)
    seen = []
    for nprobe in (1, 3, 6):
        found = cells.nearest_many_in_cells(spark, index, queries, 5, nprobe)
        seen.append(cells.recall(found, exact).agg(F.avg("recall")).first()[0])
    assert seen == sorted(seen) and seen[0] > 0.2 and math.isclose(seen[-1], 1.0)
    one = cells.nearest_in_cells(spark, index, random_rows(1, 4)[0][1], 5, 1)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan


def test_catalogue_probes_find_nine_tenths(spark, monkeypatch):
    probed = []
    one = cells.nearest_in_cells
    monkeypatch.setattr(cells, "nearest_in_cells", lambda *a: probed.append(a[-2:]) or one(*a))
    row = CATALOG["vec_08_measured"](spark, "/root/testdata/sf0.01").first()
    assert row.n_queries == 500 and row.recall >= 0.9 and row.compared <= 0.25
    assert CATALOG["vec_07_probe"](spark, "/root/testdata/sf0.01").first().n_right == 10
    assert probed == [(10, 100)]


@pytest.fixture(scope="module")
def coded(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("coded"))
    df = corpus(spark, rows + ODD).repartition(4)
    return cells.build_cells(df, path, 6, DIM, copies=2, code_bytes=4, code_sample=200)


def test_copies_and_codes(spark, rows, coded):
    entries = coded.entries(spark).where("cell >= 0").groupBy("id").agg(F.countDistinct("cell").alias("n"), F.max(F.length("code")).alias("c"))
    assert {(r.n, r.c) for r in entries.collect()} == {(2, 4)}
    assert sorted(r.id for r in coded.corpus(spark).select("id").collect()) == sorted(i for i, _ in rows + ODD)
    again = cells.open_cells(spark, coded.path)
    assert again.copies == 2 and (again.codes == coded.codes).all() and (again.centroids == coded.centroids).all()
    with pytest.raises(ValueError, match="equal parts"):
        cells.build_cells(corpus(spark, rows), coded.path + "-x", 6, DIM, code_bytes=3)


def test_probes_of_codes(spark, rows, index, coded):
    q = random_rows(1, seed=4)[0][1]
    exact = knn.nearest(corpus(spark, rows), q, 10).collect()
    assert cells.nearest_in_cells(spark, coded, q, 10, coded.cells).collect() == exact
    assert cells.nearest_in_cells(spark, coded, q, 10, coded.cells, rerank=len(rows)).collect() == exact
    queries = spark.createDataFrame(random_rows(25, 3), "query_id long, query_vector array<float>")
    want = knn.nearest_many(corpus(spark, rows), queries, 5, DIM)
    seen = []
    for nprobe, rerank in ((2, 10), (4, 40), (6, len(rows))):
        chosen = cells.candidates_in_cells(spark, coded, queries, nprobe, rerank, limits=Limits(query_rows=7))
        assert chosen.groupBy("query_id").count().agg(F.max("count")).first()[0] <= rerank
        assert chosen.distinct().count() == chosen.count()
        found = cells.compared_in_full(spark, coded, queries, chosen, 5, limits=Limits(broadcast_rows=nprobe, query_rows=nprobe))
        seen.append(cells.recall(found, want).agg(F.avg("recall")).first()[0])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert seen == sorted(seen) and seen[1] >= 0.8
    full = cells.nearest_many_in_cells(spark, coded, queries, 5, coded.cells)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="no codes"):
        cells.nearest_in_cells(spark, index, q, 10, 2, rerank=5)


def test_a_grown_index(spark, rows, tmp_path):
    """Crowded cells are split; whoever opened the index before still finds all it held."""
    path, first, rest = str(tmp_path), rows[::2], rows[1::2]
    q = random_rows(1, seed=4)[0][1]
    old = cells.build_cells(corpus(spark, first), path, 4, DIM, copies=2, code_bytes=4)
    drift = [(2_000 + i, [5.0 + x for x in v]) for i, v in random_rows(300, seed=7)]  # all in one direction
    grown = cells.append_cells(old, corpus(spark, rest + drift + ODD).repartition(3), crowded=1.2, sample=100)
    assert grown.version == 2 and grown.cells > old.cells and set(grown.numbers) - set(old.numbers)
    grown = cells.open_cells(spark, path)
    held = rows + drift
    assert sorted(r.id for r in grown.corpus(spark).select("id").collect()) == sorted(i for i, _ in held + ODD)
    exact = knn.nearest(corpus(spark, held), q, 10).collect()
    assert cells.nearest_in_cells(spark, grown, q, 10, grown.cells).collect() == exact
    queries = spark.createDataFrame(random_rows(20, 3) + [(77, [1.0] * DIM)], "query_id long, query_vector array<float>")
    want = knn.nearest_many(corpus(spark, held), queries, 5, DIM)
    found = cells.nearest_many_in_cells(spark, grown, queries, 5, 4, rerank=60)
    assert cells.recall(found, want).agg(F.avg("recall")).first()[0] >= 0.8
    assert cells.nearest_in_cells(spark, old, q, 10, old.cells).count() == 10
    same = cells.append_cells(grown, corpus(spark, [(9_000, q)]), crowded=50.0)
    assert same.version == 2 and cells.nearest_in_cells(spark, same, q, 1, 1).first().id == 9_000


def test_a_cell_of_copies_is_not_split(spark, tmp_path):
    axes = [[1.0 if d == i else 0.0 for d in range(DIM)] for i in range(4)]
    index = cells.build_cells(corpus(spark, list(enumerate(axes))), str(tmp_path), 4, DIM)
    grown = cells.append_cells(index, corpus(spark, [(100 + i, axes[0]) for i in range(50)]))
    assert grown.version == 1 and grown.corpus(spark).count() == 54


@pytest.mark.parametrize("limits", [Limits(), Limits(query_rows=8)])
def test_blocks_skipped_by_radius(spark, limits):
    """Equal distances, copies, and queries far from all, against the search without blocks."""
    near = [(i, [x * 0.02 + (3.0 if d == i % 4 else 0.0) for d, x in enumerate(v)]) for i, v in random_rows(400)]
    given = near + [(1_000 + i, near[5][1]) for i in range(60)] + ODD
    df = corpus(spark, given).repartition(5)
    asked = [(i, v) for i, v in near[:20]] + [(50, [0.0] * DIM), (51, [1.0]), (52, [1.0] * DIM), (53, [-1.0] * DIM), (54, near[5][1])]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    blocks = radius.pack_by_direction(df, DIM, 4, block_rows=32, sample=100, tasks=3)
    got = radius.nearest_many_in_blocks(blocks, queries, 7, limits=limits)
    want = knn.nearest_many(df, queries, 7, DIM)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    row = radius.compared_pairs(blocks, queries, 7, limits=limits).first()
    assert row.pairs == 23 * 460 and row.compared < row.pairs / 2
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "Cartesian" not in plan


def test_blocks_of_nothing(spark):
    queries = spark.createDataFrame(random_rows(3), "query_id long, query_vector array<float>")
    blocks = radius.pack_by_direction(corpus(spark, ODD), DIM, 4)
    assert radius.nearest_many_in_blocks(blocks, queries, 3).count() == 0
    assert radius.compared_pairs(blocks, queries, 3).first().pairs == 0
    held = radius.pack_by_direction(corpus(spark, random_rows(2)), DIM, 4)
    assert radius.nearest_many_in_blocks(held, queries, 3).count() == 6
    assert radius.nearest_many_in_blocks(held, queries.limit(0), 3).count() == 0


def nearest_by_loop(ids, units, queries, k):
    """Per query ``(steps, id)`` of its k nearest rows, every pair in double."""
    found = []
    for q in queries:
        steps = np.rint((1.0 - np.einsum("ij,j->i", units, q)) * 1e6)
        found.append(sorted((int(s), int(i)) for s, i in zip(steps, ids) if s == s)[:k])
    return found


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("scale", [1.0, 1.5])
def test_most_rows_are_left_out_by_their_products(monkeypatch, k, scale):
    """Equal distances, copies, rows and queries without direction; half the rows longer than one."""
    formed, whole = [], kernels.block_best
    monkeypatch.setattr(kernels, "block_best", lambda ids, units, queries, k: formed.append(len(ids) * len(queries)) or whole(ids, units, queries, k))
    rng = np.random.default_rng(5)
    units = kernels.unit_rows(rng.normal(size=(20_000, DIM)))
    units[::2] *= scale
    units[500], units[7_000:7_010], units[12_000] = np.nan, units[3], units[3] + 1e-8
    ids = np.sort(rng.permutation(90_000)[:20_000])
    queries = kernels.unit_rows(np.concatenate([rng.normal(size=(50, DIM)), units[[3, 500, 12_000]]]))
    tops = kernels.Nearest(queries, k)
    for part in (slice(0, 300), slice(300, 300), slice(300, 20_000)):
        tops.compare(np.arange(len(queries)), ids[part], units[part])
    got = [sorted((int(s), int(i)) for s, i in zip(*row) if s < kernels.NO_DISTANCE) for row in zip(tops.steps, tops.ids)]
    assert got == nearest_by_loop(ids, units, queries, k)
    assert sum(formed) < len(ids) * len(queries) / 8


def test_bounds_of_the_caller_and_equal_rows():
    """Rows beyond a given bound stay out; when all rows are equal, the smallest ids win."""
    rng = np.random.default_rng(6)
    units, ids = kernels.unit_rows(rng.normal(size=(3_000, DIM))), np.arange(3_000)
    queries, at = units[:5], np.arange(5)
    want = nearest_by_loop(ids, units, queries, 9)
    bound = np.array([w[4][0] for w in want])
    tops = kernels.Nearest(queries, 9, bound)
    tops.compare(at, ids, units)
    for w, b, steps, found in zip(want, bound, tops.steps, tops.ids):
        assert [(s, i) for s, i in w if s <= b] == [(s, i) for s, i in zip(steps, found) if s < kernels.NO_DISTANCE]
    tops = kernels.Nearest(queries, 4)
    tops.compare(at, ids, np.repeat(units[:1], 3_000, axis=0))
    assert (tops.ids == np.arange(4)).all()


def test_codes_bring_back_the_best_rows_only(spark, coded, monkeypatch):
    """A group compares a query with all probed cells and returns each row once; a plain loop finds the same."""
    met = []
    one = cells.meet
    monkeypatch.setattr(cells, "meet", lambda *a, **b: met.append(one(*a, **b)) or met[-1])
    asked, (nprobe, rerank) = random_rows(12, 3) + [(77, [0.0] * DIM)], (4, 10)
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    chosen = cells.candidates_in_cells(spark, coded, queries, nprobe, rerank)
    found = met[0].groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()
    assert len(found) == 12 and {(r.n, r.ids) for r in found} == {(rerank, rerank)}
    known, want = kernels.Cells(*coded.known), set()
    entries = coded.entries(spark).where("code is not null").select("id", "code", "cell").collect()
    for query_id, vector in asked[:12]:
        unit = kernels.unit_rows(np.asarray(vector, dtype=np.float32).astype(np.float64)[None, :])
        best = {}
        for r in entries:
            if r.cell in coded.probe(unit, nprobe)[0]:
                row = known.decode(np.frombuffer(r.code, dtype=np.uint8)[None, :], r.cell)
                best[r.id] = min(best.get(r.id, 9.0), round(float(1 - unit[0] @ row[0]), 6))
        want |= {(query_id, i) for _, i in sorted((d, i) for i, d in best.items())[:rerank]}
    assert set(map(tuple, chosen.collect())) == want


@pytest.mark.parametrize("block_bytes", [32_000_000, 2_000])
def test_many_chosen_pairs_meet_by_blocks(spark, tmp_path, block_bytes):
    """Ids of pairs move to blocks of vectors; an id with several rows, odd rows and unknown ids among them."""
    rows = random_rows(60) + random_rows(9, seed=2) + ODD
    index = cells.build_cells(corpus(spark, rows), str(tmp_path), 3, DIM)
    asked = random_rows(14, 3) + [(77, [0.0] * DIM), (None, [1.0] * DIM)]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    pairs = [(q, i) for q, _ in asked for i, _ in rows if i < 901 and (q is None or (q * 7 + i) % 3)] + [(0, 5_000), (888, 1), (1, None)]
    chosen = spark.createDataFrame(pairs, "query_id long, id long").repartition(3)
    few, many = (
        cells.compared_in_full(spark, index, queries, chosen, 5, limits=Limits(broadcast_rows=n, block_bytes=block_bytes, literal_rows=10))
        for n in (10_000, 10)
    )
    assert "CoGroup" in many._jdf.queryExecution().toString()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and many.count() == 70
