"""Contract rules on hand-made graphs."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphs import graph_of
from hopline.model import NODE_SCHEMA, conform
from hopline.operators import checks, filters, paths, pattern, traverse
from hopline.sources import tables


def values(df):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.collect())


def count(df):
    return int(df.first()[0])


def test_parallel_edges_separate_the_counting_rules(spark):
    # 1 -> 2 twice (types a and b), 2 -> 3 twice at different times.
    edges = [(1, 2, "a", 0), (1, 2, "b", 0), (2, 3, "a", 1), (2, 3, "a", 2), (2, 4, "a", 1)]
    graph = graph_of(spark, range(1, 5), edges)
    assert values(traverse.walk_rows(graph, 1, 1)) == [2, 2]
    assert values(traverse.ends(graph, 1, 1)) == [2]
    assert count(traverse.walk_count(graph, 1, 2)) == 6
    assert count(traverse.walk_count(graph, 1, 2, simple=True)) == 2
    assert count(traverse.end_count(graph, 1, 2)) == 2
    assert values(traverse.walk_rows(graph, 1, 2)) == [3, 3, 3, 3, 4, 4]
    assert values(filters.simple_edges(graph.edges)) == [(1, 2), (2, 3), (2, 4)]


def test_walks_revisit_nodes(spark):
    graph = graph_of(spark, [(1, "x"), (2, "y")], [(1, 2), (2, 1)])
    assert values(pattern.triples(graph, "y", 10)) == [(1, 2, 1)]
    assert values(traverse.walk_rows(graph, 1, 3)) == [2]
    assert values(traverse.ends(graph, 1, 4)) == [1]


def test_missing_nodes(spark):
    edges = [(1, 2), (2, 9), (9, 3), (8, 1)]
    graph = graph_of(spark, [1, 2, 3], edges)
    assert values(checks.missing_endpoints(graph)) == [("dst", 9, 1), ("src", 8, 1), ("src", 9, 1)]
    assert values(traverse.walk_rows(graph, 2, 1)) == []
    assert count(traverse.walk_count(graph, 1, 3)) == 0
    assert count(traverse.end_count(graph, 1, 3)) == 0
    assert paths.shortest_length(graph, 1, 3).count() == 0
    assert values(paths.reach(graph, 1)) == [(1, 0), (2, 1)]
    assert values(paths.reach(graph, 77)) == []


def test_sinks_and_unknown_sources_count_zero(spark):
    graph = graph_of(spark, [1, 2], [(1, 2)], endpoints_ok=True)
    assert count(traverse.walk_count(graph, 2, 3)) == 0
    assert count(traverse.walk_count(graph, 77, 2)) == 0
    assert count(traverse.end_count(graph, 2, 2)) == 0
    assert values(traverse.walk_rows(graph, 2, 1)) == []


def test_path_to_itself_is_the_shortest_cycle(spark):
    graph = graph_of(spark, range(1, 6), [(1, 2), (2, 3), (3, 1), (4, 4)])
    assert values(paths.shortest_length(graph, 1, 1)) == [(1, 1, 3)]
    assert values(paths.shortest_length(graph, 4, 4)) == [(4, 4, 1)]
    assert values(paths.shortest_length(graph, 5, 5)) == []
    route = paths.shortest_route(graph, 1, 1).orderBy("step").collect()
    assert [r.node for r in route] == [1, 2, 3, 1]


def test_smallest_predecessor_decides_between_equal_routes(spark):
    # Two routes of length 3; going back from 9, predecessor 4 beats 5.
    edges = [(1, 2), (1, 3), (2, 5), (3, 4), (5, 9), (4, 9), (2, 6)]
    graph = graph_of(spark, [1, 2, 3, 4, 5, 6, 9], edges)
    route = paths.shortest_route(graph, 1, 9).orderBy("step").collect()
    assert [r.node for r in route] == [1, 3, 4, 9]
    one = spark.createDataFrame([(1,)], "node long")
    other = spark.createDataFrame([(9,)], "node long")
    many = paths.shortest_routes(graph, one, other).orderBy("step").collect()
    assert [r.node for r in many] == [1, 3, 4, 9]
    assert paths.broken_steps(graph, paths.shortest_route(graph, 1, 9)).count() == 0


def test_hop_bound_is_reported(spark):
    graph = graph_of(spark, range(6), [(i, i + 1) for i in range(5)])
    search = paths.search_pair(graph, 0, 5, max_hops=4)
    assert search.bound_hit and search.lengths(spark).count() == 0
    found = paths.search_pair(graph, 0, 5, max_hops=5)
    assert not found.bound_hit and found.lengths(spark).first().length == 5
    cut_off = paths.search_pair(graph, 5, 0)
    assert not cut_off.bound_hit and cut_off.lengths(spark).count() == 0
    start = spark.createDataFrame([(0,)], "node long")
    goal = spark.createDataFrame([(5,)], "node long")
    assert paths.search_many(graph, start, goal, max_hops=4).bound_hit
    assert not paths.search_many(graph, start, goal, max_hops=5).bound_hit


def test_window_includes_both_ends_and_ignores_order(spark):
    edges = [(1, 2, "a", 20), (2, 3, "a", 10), (3, 4, "a", 15), (1, 3, "a", 9), (1, 4, "a", 21)]
    graph = graph_of(spark, range(1, 5), edges)
    window = traverse.time_slice(graph, 10, 20)
    assert window.edges.count() == 3
    assert count(traverse.walk_count(window, 1, 3)) == 1


def test_pattern_limit_order_and_sets(spark):
    nodes = [(1, "p"), (2, "q"), (3, "q"), (4, "p"), (5, "q")]
    edges = [(1, 2), (1, 2, "other"), (1, 5), (4, 3), (2, 4), (2, 1), (3, 1), (3, 1)]
    graph = graph_of(spark, nodes, edges)
    # 5 has no outgoing edge and so matches nothing.
    bag = [(1, 2, 1), (1, 2, 1), (1, 2, 4), (1, 2, 4), (4, 3, 1), (4, 3, 1)]
    assert [tuple(r) for r in pattern.triples(graph, "q", 10).collect()] == bag
    assert [tuple(r) for r in pattern.triples(graph, "q", 3).collect()] == bag[:3]
    assert [tuple(r) for r in pattern.distinct_triples(graph, "q", 2).collect()] == [
        (1, 2, 1),
        (1, 2, 4),
    ]
    assert count(pattern.triple_count(graph, "q")) == 6
    assert pattern.any_triples(graph, "q", 4).count() == 4
    assert pattern.triples(graph, "none", 4).count() == 0
    assert count(pattern.triple_count(graph, "none")) == 0


def test_pattern_counts_only_matches_between_nodes(spark):
    graph = graph_of(spark, [(1, "p"), (2, "q")], [(1, 2), (8, 2), (2, 9), (2, 1)])
    assert values(pattern.triples(graph, "q", 10)) == [(1, 2, 1)]
    assert count(pattern.triple_count(graph, "q")) == 1


def test_key_violations(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, v string")
    found = {(r.id, r.n) for r in checks.key_violations(df, ["id"]).collect()}
    assert found == {(1, 2), (None, 1)}


def test_latest_row_per_key_wins(spark):
    edges = [(1, 2, "a", 5), (1, 2, "a", 9), (1, 2, "b", 1), (1, 2, "a", 7)]
    graph = graph_of(spark, [1, 2], edges)
    keys = ["src", "dst", "edge_type"]
    assert values(tables.latest_per_key(graph.edges, keys, "ts")) == [
        (1, 2, "a", 9),
        (1, 2, "b", 1),
    ]
    nodes = spark.createDataFrame(
        [(1, "old", 1.0, 3), (1, "new", 2.0, 8), (1, "tie", 9.0, 8), (2, "x", 0.0, 0)], NODE_SCHEMA
    )
    assert values(tables.latest_per_key(nodes, ["id"], "ts")) == [
        (1, "tie", 9.0, 8),
        (2, "x", 0.0, 0),
    ]


def test_declared_schema_rejects_bad_values(spark):
    fields = "id string, category string, value string, ts string"
    good = spark.createDataFrame([("1", "x", "0.5", "7")], fields)
    assert conform(good, NODE_SCHEMA).collect() == [(1, "x", 0.5, 7)]
    bad = good.withColumn("id", F.lit("one"))
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(PySparkException, match="does not fit"):
                conform(bad, NODE_SCHEMA).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_self_loops(spark):
    graph = graph_of(spark, [1, 2], [(1, 1), (1, 2)])
    assert filters.without_self_loops(graph.edges).count() == 1
    assert filters.self_loops(graph.edges).count() == 1


def test_reversed_graph(spark):
    graph = graph_of(spark, [1, 2, 3], [(1, 2), (2, 3)])
    assert values(traverse.ends(graph.reversed(), 3, 2)) == [1]
