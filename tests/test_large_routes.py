"""The routes for large and skewed data, forced on small graphs, against brute force."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphs import TINY, Brute, graph_of, hub_edges
from hopline.operators import paths, pattern, traverse
from hopline.plans.limits import Limits
from hopline.plans.lineage import settle
from hopline.plans.skew import hub_table, repeat_rows
from hopline.sources import tables

NODES = 30


@pytest.fixture(scope="module", params=["plain", "tiny", "split"])
def case(request, spark, tmp_path_factory):
    edges = hub_edges(seed=5)
    nodes = [(n, "even" if n % 2 == 0 else "odd") for n in range(NODES)]
    limits = Limits() if request.param == "plain" else TINY
    graph = graph_of(spark, nodes, edges, limits=limits, endpoints_ok=request.param != "tiny")
    if request.param == "split":
        where = str(tmp_path_factory.mktemp("split"))
        graph = tables.split_edges(graph, where, "split_test", 4)
    return graph, edges, Brute(edges)


def pairs(df):
    return {r[0]: int(r[1]) for r in df.collect()}


def test_walks(case):
    graph, _, brute = case
    for hops in (1, 2, 4):
        assert pairs(traverse.walk_ends(graph, 1, hops)) == brute.walks(1, hops)
        assert pairs(traverse.walk_ends(graph, 1, hops, simple=True)) == brute.walks(1, hops, True)
        ends = sorted(r.node for r in traverse.ends(graph, 1, hops).collect())
        assert ends == sorted(brute.walks(1, hops))
    rows = [r.node for r in traverse.walk_rows(graph, 1, 2).collect()]
    assert sorted(rows) == sorted(brute.walks(1, 2).elements())


def test_reach(case):
    graph, _, brute = case
    want = dict(brute.distances(1)) | {1: 0}
    assert pairs(paths.reach(graph, 1)) == want


def test_pairs(case, spark):
    graph, _, brute = case
    for source, target in [(1, 2), (3, 17), (4, 4), (29, 0)]:
        far = brute.distances(source).get(target)
        got = [r.length for r in paths.shortest_length(graph, source, target).collect()]
        assert got == ([far] if far else [])
        route = [r.node for r in paths.shortest_route(graph, source, target).orderBy("step").collect()]
        assert route == (brute.route(source, target) or [])


def test_many_pairs(case, spark):
    graph, _, brute = case
    sources, targets = [1, 3, 4, 29], [2, 4, 17, 28]
    s = spark.createDataFrame([(n,) for n in sources], "node long")
    t = spark.createDataFrame([(n,) for n in targets], "node long")
    got = {(r.source, r.target): r.length for r in paths.shortest_lengths(graph, s, t).collect()}
    want = {
        (a, b): brute.distances(a)[b] for a in sources for b in targets if b in brute.distances(a)
    }
    assert got == want
    routes = paths.shortest_routes(graph, s, t)
    by_pair = {}
    for r in routes.orderBy("source", "target", "step").collect():
        by_pair.setdefault((r.source, r.target), []).append(r.node)
    assert by_pair == {pair: brute.route(*pair) for pair in want}
    assert paths.broken_steps(graph, routes).count() == 0


@pytest.mark.parametrize("n_sources,n_targets,limits", [(150, 5, Limits()), (70, 140, TINY)])
def test_lanes_of_many_sources(spark, n_sources, n_targets, limits):
    """More roots than a lane holds, from either end, with levels too large to broadcast."""
    rng = random.Random(n_sources)
    nodes = range(160)
    edges = [(rng.randrange(160), rng.randrange(160)) for _ in range(260)] + [(1, n) for n in range(40)]
    brute = Brute(edges)
    sources, targets = rng.sample(nodes, n_sources), rng.sample(nodes, n_targets)
    relation = lambda ids: spark.createDataFrame([(n,) for n in [*ids, ids[0], 999, None]], "node long")
    far = {a: brute.distances(a) for a in sources}
    want = {(a, b): far[a][b] for a in sources for b in targets if b in far[a]}
    graph = graph_of(spark, nodes, edges, limits=limits)
    found = paths.shortest_lengths(graph, relation(sources), relation(targets)).collect()
    assert {(r.source, r.target): r.length for r in found} == want and len(found) == len(want)
    near = paths.shortest_lengths(graph, relation(sources), relation(targets), max_hops=2).collect()
    assert {(r.source, r.target): r.length for r in near} == {p: d for p, d in want.items() if d <= 2}
    assert all(r.bound_hit for r in near)


def test_visited_nodes_stay_in_their_buckets(spark):
    """Beyond the broadcast bound only arrivals are shuffled, to the buckets of what was visited."""
    tables_before = len(spark.catalog.listTables())
    pair = lambda lo, hi: spark.range(lo, hi).select(F.lit(1).cast("long").alias("root"), F.col("id").alias("node"))
    with paths.Visited(Limits(broadcast_rows=5)) as seen:
        for lo, hi in ((0, 3), (3, 9), (9, 20)):
            seen.add(settle(pair(lo, hi)))
        new = seen.unseen(pair(15, 25).groupBy("root", "node").agg(F.count("*").alias("n")))
        assert sorted(r.node for r in new.collect()) == [20, 21, 22, 23, 24]
        plan = new._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        visited = plan[plan.index("LeftAnti"):]
        scan = visited[: visited.index("visited_")].splitlines()
        assert "Bucketed: true" in visited and "SelectedBucketsCount" in visited
        assert not any("Exchange" in line for line in scan[-4:])
        assert new._jdf.queryExecution().toString().split("Physical Plan")[1].split("Initial Plan")[0].count("Exchange") == 1
    assert len(spark.catalog.listTables()) == tables_before


def test_edges_are_dealt_out_once(spark, monkeypatch):
    """Searches with frontiers too large to broadcast shuffle the edges once, not in each round."""
    stored, real = [], tables.split_edges
    monkeypatch.setattr(paths, "split_edges", lambda *a: stored.append(a[2]) or real(*a), raising=False)
    edges, tables_before = hub_edges(seed=6), len(spark.catalog.listTables())
    graph = graph_of(spark, range(NODES), [*edges, (None, 3)], limits=TINY)
    brute = Brute(edges)
    assert pairs(paths.reach(graph, 3)) == brute.distances(3) | {3: 0}
    assert len(stored) == 1
    ends = spark.createDataFrame([(n,) for n in (1, 3, 4)], "node long")
    want = {(a, b): d for a in (1, 3, 4) for b, d in brute.distances(a).items() if b in (1, 3, 4)}
    found = paths.shortest_lengths(graph, ends, ends).collect()
    assert {(r.source, r.target): r.length for r in found} == want and len(stored) == 2
    routes = paths.shortest_routes(graph, ends, ends).groupBy("source", "target").count().collect()
    assert {(r.source, r.target): r["count"] - 1 for r in routes} == want and len(stored) == 3
    assert len(spark.catalog.listTables()) == tables_before


def test_few_arrivals_are_looked_up_among_the_nodes(spark):
    """Not joined with all nodes, which Spark may broadcast in each round of a long search."""
    chain = graph_of(spark, [1, 2, 2, 4], [(1, 2), (1, 3), (1, None), (2, 4)])
    here = settle(spark.sql("select 1L as root, 1L as node"))
    for root in (1, None):
        level = paths._next_level(chain, here, paths.Visited(chain.limits), root)
        assert [(r.root, r.node, r.parent) for r in level.collect()] == [(1, 2, 1)]
        assert "IN (2,3)" in level._jdf.queryExecution().analyzed().toString().replace("cast(", "").replace(" as bigint)", "")


def test_a_lane_holds_a_node_once(spark):
    """A row per lane, not per root: 128 roots lead to one node."""
    graph = graph_of(spark, range(200), [(n, 199) for n in range(128)] + [(199, 198)], endpoints_ok=True)
    roots = settle(spark.range(128).select(F.col("id").alias("node")))
    goals = settle(spark.range(197, 199).select(F.col("id").alias("node")))
    search = paths.search_lanes(graph, roots, goals)
    assert [d for d, _ in search.pairs] == [2] and search.found == 128
    seen = paths.Lanes(graph.limits)
    arrivals = spark.range(128).select(F.lit(199).cast("long").alias("node"), (F.col("id") / 64).cast("long").alias("lane"), F.expr("shiftleft(1L, cast(id % 64 as int))").alias("bits"))
    level = settle(seen.unseen(arrivals))
    assert level.rows == 2 and all(r.bits == -1 for r in level.head)
    seen.add(level)
    assert seen.unseen(arrivals).count() == 0


def test_pattern(case):
    graph, edges, _ = case
    matches = sorted(
        (a, b, c)
        for a, b, *_ in edges
        if b % 2 == 0
        for src, c, *_ in edges
        if src == b
    )
    assert int(pattern.triple_count(graph, "even").first()[0]) == len(matches)
    for limit in (1, 7, 50, 10_000):
        got = [tuple(r) for r in pattern.triples(graph, "even", limit).collect()]
        assert got == matches[:limit]
        got = [tuple(r) for r in pattern.distinct_triples(graph, "even", limit).collect()]
        assert got == sorted(set(matches))[:limit]
    some = [tuple(r) for r in pattern.any_triples(graph, "even", 20).collect()]
    assert len(some) == 20 and set(some) <= set(matches)


def test_many_middle_nodes_are_counted_without_moving_edges(spark):
    """No hubs are looked for and no edges joined: both degrees are added up in each task."""
    edges = hub_edges(seed=7)
    graph = graph_of(spark, [(n, "even" if n % 2 == 0 else "odd") for n in range(NODES)], edges, limits=TINY, endpoints_ok=True)
    want = sum(1 for _, b, *_ in edges if b % 2 == 0 for src, *_ in edges if src == b)
    assert int(pattern.triple_count(graph, "even").first()[0]) == want
    assert not graph._hubs


def test_first_pairs_of_many_middle_nodes_need_no_hubs(spark):
    """The first start nodes lead to few middle nodes; only these are compared."""
    edges = [(a, 100 + a % 40) for a in range(60)] + [(100 + b, b) for b in range(40)]
    limits = Limits(literal_rows=1, broadcast_rows=20)
    graph = graph_of(spark, [*range(60), *[(100 + b, "q") for b in range(40)]], edges, limits=limits, endpoints_ok=True)
    want = sorted((a, 100 + a % 40, a % 40) for a in range(60))[:5]
    assert [tuple(r) for r in pattern.triples(graph, "q", 5).collect()] == want
    assert [tuple(r) for r in pattern.distinct_triples(graph, "q", 5).collect()] == want
    assert not graph._hubs


def test_time_slice(case):
    graph, edges, _ = case
    kept = [e for e in edges if 20 <= e[3] <= 70]
    window = traverse.time_slice(graph, 20, 70)
    assert pairs(traverse.walk_ends(window, 1, 3)) == Brute(kept).walks(1, 3)


@pytest.mark.parametrize("limits", [Limits(), TINY])
@pytest.mark.parametrize("gone", [[], [9], [1, 2, 11, 20]])
def test_edges_to_missing_nodes_are_dropped(spark, limits, gone):
    edges = hub_edges(seed=8)
    kept = [n for n in range(NODES) if n not in gone]
    graph = graph_of(spark, [(n, "abc"[n % 3]) for n in kept], edges, limits=limits)
    sound = [e for e in edges if e[0] in kept and e[1] in kept]
    brute = Brute(sound)
    checked = graph.checked()
    assert checked.endpoints_ok
    got = sorted(tuple(r) for r in checked.edges.collect())
    assert got == sorted(sound)
    assert pairs(traverse.walk_ends(graph, 3, 3)) == brute.walks(3, 3)
    assert int(traverse.walk_count(graph, 3, 3).first()[0]) == sum(brute.walks(3, 3).values())
    rows = sorted(r.node for r in traverse.walk_rows(graph, 3, 2).collect())
    assert rows == sorted(brute.walks(3, 2).elements())
    assert pairs(paths.reach(graph, 3)) == brute.distances(3) | {3: 0}
    matches = sorted(
        (a, b, c) for a, b, *_ in sound if b % 3 == 0 for src, c, *_ in sound if src == b
    )
    assert [tuple(r) for r in pattern.triples(graph, "a", 40).collect()] == matches[:40]
    assert int(pattern.triple_count(graph, "a").first()[0]) == len(matches)


def test_pairs_that_lead_nowhere_do_not_shorten_the_result(spark):
    # Hundreds of early pairs end in a sink; the matches come after them.
    edges = [(a, 1_000) for a in range(400)] + [(500 + a, 2_000) for a in range(5)]
    edges += [(2_000, 7), (2_000, 8)]
    nodes = [(1_000, "q"), (2_000, "q")]
    graph = graph_of(spark, nodes, edges, endpoints_ok=True)
    want = [(500 + a, 2_000, c) for a in range(5) for c in (7, 8)]
    for limit in (1, 3, 100):
        got = [tuple(r) for r in pattern.triples(graph, "q", limit).collect()]
        assert got == want[:limit]
        got = [tuple(r) for r in pattern.distinct_triples(graph, "q", limit).collect()]
        assert got == want[:limit]


def test_hub_list_is_bounded(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), 0) for _ in range(2_000)] + [(5, i) for i in range(1_000)]
    graph = graph_of(spark, [0], edges)
    limits = Limits(hub_share=10, hub_rows=1)
    hubs = hub_table(graph.edges, "src", limits).collect()
    assert [h.hub for h in hubs] == [5] and hubs[0].splits > 1


def test_repeats_are_cut_into_chunks(spark):
    df = spark.createDataFrame([(1, 25), (2, 1), (3, 10)], "node long, times long")
    got = sorted(r.node for r in repeat_rows(df, "times", chunk=10).collect())
    assert got == [1] * 25 + [2] + [3] * 10


def test_bucketed_part_is_not_shuffled(spark, tmp_path):
    from hopline.plans.lineage import settle
    from hopline.plans.skew import expand

    graph = graph_of(spark, range(NODES), hub_edges(3), limits=TINY, endpoints_ok=True)
    split = tables.split_edges(graph, str(tmp_path), "split_plan", 4)
    frontier = settle(spark.range(NODES).select("id").withColumnRenamed("id", "node"), TINY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cold = split.cold_and_hot()[0].select("src", "dst")
        plan = cold.join(frontier.df, cold.src == frontier.df.node)._jdf.queryExecution().toString()
        assert expand(split, frontier).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    physical = plan[plan.index("== Physical Plan") :]
    assert physical.count("Exchange") == 1 and "Bucketed: true" in physical


def test_paths_have_no_hop_limit(spark):
    chain = graph_of(spark, range(45), [(i, i + 1) for i in range(44)])
    assert [r.length for r in paths.shortest_length(chain, 0, 40).collect()] == [40]
    assert pairs(paths.reach(chain, 3)) == {n: n - 3 for n in range(3, 45)}
    bound = paths.reach(chain, 3, max_hops=5).collect()
    assert len(bound) == 6 and all(r.bound_hit for r in bound)
    assert [r.bound_hit for r in paths.shortest_length(chain, 0, 40, max_hops=9).collect()] == [True]


def test_stored_parts_keep_their_own_hubs(spark, tmp_path_factory):
    edges = hub_edges(seed=5)
    graph = graph_of(spark, range(NODES), edges, limits=TINY, endpoints_ok=True)
    split = tables.split_edges(graph, str(tmp_path_factory.mktemp("kept")), "kept_parts", 4)
    other = Limits(literal_rows=1, broadcast_rows=2, hub_share=8, hub_rows=1_000)
    for limits in (TINY, other):
        again = replace(split, limits=limits, _hubs={})
        assert pairs(traverse.walk_ends(again, 1, 2)) == Brute(edges).walks(1, 2)


def test_pattern_beyond_the_window_limit(spark):
    edges = [(0, 1)] + [(1, 10 + i) for i in range(1_200)]
    graph = graph_of(spark, [0, (1, "even"), *range(10, 1_210)], edges)
    got = [tuple(r) for r in pattern.triples(graph, "even", 1_001).collect()]
    assert got == [(0, 1, 10 + i) for i in range(1_001)]
