"""Known answers for the commerce graph."""

import pytest
from pyspark.sql import functions as F

from hopline.operators import hybrid, knn, measure, paths, pattern, traverse
from hopline.plans import catalog, commerce
from hopline.plans.commerce import node_id

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
S = node_id("customer", 0)


@pytest.fixture(scope="module", params=[SMALL, MIDDLE])
def case(request, spark):
    graph = commerce.commerce_graph(spark, request.param)
    return request.param == MIDDLE, graph, request.param


def one(df):
    return int(df.first()[0])


def test_sizes(case):
    middle, graph, _ = case
    assert graph.nodes.count() == (18_630 if middle else 1_890)
    assert graph.edges.count() == (211_625 if middle else 21_185)
    keys = graph.edges.select("src", "dst", "edge_type").distinct().count()
    assert keys == (203_246 if middle else 16_974)


def test_walks_and_ends(case):
    middle, graph, _ = case
    want = {2: (62, 50), 3: (3_182, 1_487)} if middle else {2: (53, 40), 3: (2_678, 838)}
    for hops, (walks, ends) in want.items():
        assert one(traverse.walk_count(graph, S, hops)) == walks
        assert one(traverse.end_count(graph, S, hops)) == ends
        assert traverse.walk_rows(graph, S, hops).count() == walks


def test_window_walks(case):
    middle, graph, _ = case
    window = traverse.time_slice(graph, catalog.TS_LO, catalog.TS_HI)
    bag, simple, ends = (643, 620, 380) if middle else (652, 490, 260)
    assert one(traverse.walk_count(window, S, 3)) == bag
    assert one(traverse.walk_count(window, S, 3, simple=True)) == simple
    assert one(traverse.end_count(window, S, 3)) == ends


def test_pattern(case):
    middle, graph, _ = case
    assert one(pattern.triple_count(graph, "supplier")) == (60_000 if middle else 6_000)
    if middle:
        rows = pattern.triples(graph, "supplier", 1_000).collect()
        assert rows[0].a == node_id("part", 0) and max(r.a for r in rows) == node_id("part", 32)
        assert sum(r.a - node_id("part", 0) for r in rows) == 15_916
        assert sum(r.c - node_id("nation", 0) for r in rows) == 11_707
        assert len({tuple(r) for r in rows}) == 861


def test_paths(case):
    middle, graph, _ = case
    goals = {
        node_id("customer", 1): 4,
        node_id("order", 0): 5 if middle else 3,
        node_id("part", 7): 4,
        node_id("supplier", 5): 3,
        node_id("region", 3): 5,
    }
    for target, length in goals.items():
        assert paths.shortest_length(graph, S, target).first().length == length
    assert paths.shortest_length(graph, node_id("region", 0), S).count() == 0
    if middle:
        route = paths.shortest_route(graph, S, node_id("customer", 1)).orderBy("step")
        assert [r.node for r in route.collect()] == [
            S,
            node_id("order", 4089),
            node_id("part", 32),
            node_id("order", 12523),
            node_id("customer", 1),
        ]


def test_reach(case):
    middle, graph, _ = case
    levels = paths.reach(graph, S).groupBy("distance").count().orderBy("distance").collect()
    want = [1, 13, 49, 1474, 2730, 13481, 745, 137] if middle else [1, 12, 39, 826, 318, 691, 3]
    assert [r["count"] for r in levels] == want


def test_nearest_and_hybrid(case, spark):
    middle, graph, sf_dir = case
    vectors = commerce.commerce_vectors(spark, sf_dir)
    q = vectors.where(F.col("id") == node_id("part", 0)).first().embedding
    near = [(r.id - node_id("part", 0), r.distance) for r in knn.nearest(vectors, q, 3).collect()]
    assert near == (
        [(0, 0.0), (365, 0.630006), (334, 0.637278)]
        if middle
        else [(0, 0.0), (17, 0.665544), (225, 0.684873)]
    )
    rows = hybrid.neighbours_of_nearest(graph, vectors, q, 10)
    assert one(hybrid.neighbour_count(rows)) == (560 if middle else 222)
    assert one(hybrid.distinct_neighbour_count(rows)) == (372 if middle else 114)


def test_summary(spark):
    got = measure.summarise(commerce.samples(spark, MIDDLE), by=["query"])
    rows = {r.query: (r.iters, r.min_ms, r.median_ms, r.p95_ms, r.max_ms) for r in got.collect()}
    assert rows == {
        "click": (2006, 0.01, 35.31, 152.04, 490.02),
        "error": (2014, 0.03, 34.39, 143.52, 346.73),
        "purchase": (1981, 0.01, 33.95, 142.5, 370.71),
        "signup": (2017, 0.05, 35.92, 151.77, 351.44),
        "view": (1982, 0.02, 33.835, 143.8, 337.16),
    }


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_reach_the_scans(spark):
    sf_dir = "/root/testdata/sf0.001"
    part = commerce.node_id("part", 7)
    node = commerce.commerce_graph(spark, sf_dir, ids=[part]).nodes
    assert "EqualTo(p_partkey,7)" in _scans(node) and "orders.parquet" not in _scans(node)
    edges = commerce.commerce_graph(spark, sf_dir, sources=[part, part + 1]).edges
    assert "In(l_partkey, [7,8])" in _scans(edges) and "orders.parquet" not in _scans(edges)
    window = commerce.commerce_graph(spark, sf_dir, window=(820454400000, 946684800000)).edges
    assert "GreaterThanOrEqual(l_shipdate" in _scans(window) and "nation.parquet" not in _scans(window)
    every = commerce.commerce_graph(spark, sf_dir).edges
    assert _scans(every).count("lineitem.parquet") == 1
