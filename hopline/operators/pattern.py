"""The two-edge pattern ``(a) -> (b {category}) -> (c)``.

Ordered by ``(a, b, c)`` and cut to ``limit`` rows, or counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.model import PropertyGraph
from hopline.operators.filters import nodes_in_category
from hopline.plans.lineage import Settled, settle
from hopline.plans.skew import first_rows, leaving, match_keys

#: Factors by which a search among the first rows is widened before it takes all.
WIDER = (1, 16, 256)


def _middles(graph: PropertyGraph, category: str) -> Settled:
    """``(node)``: nodes of the category."""
    chosen = nodes_in_category(graph, category).select(F.col("id").alias("node"))
    return settle(chosen.distinct(), graph.limits)


def _leading_on(graph: PropertyGraph, middles: Settled) -> Settled:
    """``(node)``: the middle nodes with an outgoing edge."""
    starts = graph.edges.select("src").distinct()
    onward = middles.df.join(starts, F.col("node") == F.col("src"), "left_semi")
    return settle(onward, graph.limits)


def _first_edges(
    graph: PropertyGraph, edges: DataFrame | None, middles: Settled, distinct: bool
) -> DataFrame:
    """``(a, b)``: those of ``edges`` (None: of all) that lead into the middle nodes."""
    incoming = match_keys(graph, edges, "dst", middles)
    pairs = incoming.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return pairs.distinct() if distinct else pairs


def _among_targets(graph: PropertyGraph, edges: DataFrame, middles: Settled) -> Settled:
    """The middle nodes that some edges lead to, if these have few targets; else all middle nodes."""
    targets = settle(edges.select(F.col("dst").alias("node")).where("node is not null").distinct(), graph.limits)
    if targets.rows > graph.limits.broadcast_rows:
        return middles
    return settle(middles.df.join(F.broadcast(targets.df), "node", "left_semi"), graph.limits)


def _first_pairs(graph: PropertyGraph, middles: Settled, n: int, distinct: bool) -> Settled:
    """The first ``n`` pairs by ``(a, b)``.

    A broadcast of the middle nodes filters the edges where they are. More middle
    nodes than that would mean shuffling all edges, so only those of the first
    start nodes are tried, then of more, until they hold enough pairs.
    """
    edges = graph.edges.select("src", "dst")
    if middles.rows > graph.limits.broadcast_rows:
        starts = edges.select("src").distinct().orderBy("src")
        for factor in WIDER:
            last, found = starts.limit(n * factor).agg(F.max("src"), F.count("*")).first()
            if found < n * factor:
                break
            within = edges.where(F.col("src") <= last)
            pairs = _first_edges(graph, within, _among_targets(graph, within, middles), distinct)
            kept = settle(pairs.orderBy("a", "b").limit(n), graph.limits)
            if kept.rows == n:
                return kept
    if distinct:
        # The first n start nodes already give enough different pairs. Finding them
        # takes a shuffle of start nodes, not of edges.
        starts = _first_edges(graph, None, middles, False).select("a").distinct()
        last = starts.orderBy("a").limit(n).agg(F.max("a")).first()[0]
        if last is not None:
            within = edges.where(F.col("src") <= last)
            pairs = _first_edges(graph, within, middles, distinct)
            return settle(pairs.orderBy("a", "b").limit(n), graph.limits)
    pairs = _first_edges(graph, None, middles, distinct)
    return settle(pairs.orderBy("a", "b").limit(n), graph.limits)


def _extended(graph: PropertyGraph, pairs: Settled, limit: int, distinct: bool) -> DataFrame:
    """The first ``limit`` triples that begin with ``pairs``.

    No middle node needs more than its first ``limit`` ends; they are picked before
    the join, by each task for itself first.
    """
    chosen = settle(pairs.df.select(F.col("b").alias("node")).distinct(), graph.limits)
    second = leaving(graph, chosen).select(F.col("src").alias("b"), F.col("dst").alias("c"))
    second = second.distinct() if distinct else second
    ends = first_rows(second, ["b"], ["c"], limit)
    first = F.broadcast(pairs.df) if pairs.rows <= graph.limits.broadcast_rows else pairs.df
    return ends.join(first, "b").select("a", "b", "c").orderBy("a", "b", "c").limit(limit)


def _first_triples(graph: PropertyGraph, category: str, limit: int, distinct: bool) -> DataFrame:
    """Extend the first pairs; a full result is exact, as later pairs sort behind it.

    Pairs whose middle node leads nowhere can leave it short. Then more pairs are
    taken, in the end only such that lead on, of which ``limit`` are always enough.
    """
    graph = graph.checked()
    middles = _middles(graph, category)
    for factor in WIDER:
        pairs = _first_pairs(graph, middles, limit * factor, distinct)
        found = settle(_extended(graph, pairs, limit, distinct), graph.limits)
        if found.rows == limit or pairs.rows < limit * factor:
            return found.df.orderBy("a", "b", "c")
    pairs = _first_pairs(graph, _leading_on(graph, middles), limit, distinct)
    return _extended(graph, pairs, limit, distinct)


def triples(graph: PropertyGraph, category: str, limit: int) -> DataFrame:
    """``(a, b, c)``: the first ``limit`` matches, parallel edges matching apart."""
    return _first_triples(graph, category, limit, distinct=False)


def distinct_triples(graph: PropertyGraph, category: str, limit: int) -> DataFrame:
    """``(a, b, c)``: the first ``limit`` different matches."""
    return _first_triples(graph, category, limit, distinct=True)


def any_triples(graph: PropertyGraph, category: str, limit: int) -> DataFrame:
    """Some ``limit`` matches, in no order."""
    graph = graph.checked()
    middles = _leading_on(graph, _middles(graph, category))
    pairs = _first_edges(graph, None, middles, distinct=False).limit(limit)
    return _extended(graph, settle(pairs, graph.limits), limit, distinct=False)


def _degrees(edges: DataFrame) -> DataFrame:
    """``(node, n_in, n_out)`` of the nodes with edges on both sides, in one scan."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("dst").alias("node"), one.alias("n_in"), none.alias("n_out")),
                F.struct(F.col("src").alias("node"), none.alias("n_in"), one.alias("n_out")),
            )
        )
    )
    counted = ends.groupBy("node").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    return counted.where((F.col("n_in") > 0) & (F.col("n_out") > 0))


def triple_count(graph: PropertyGraph, category: str) -> DataFrame:
    """``(matches)``: how many matches there are, without forming any.

    A middle node has in-degree times out-degree matches. Edges that do not touch
    a middle node are left out on either side before both degrees are aggregated;
    the join shares their partitioning. With more middle nodes than may be broadcast,
    both degrees of all nodes are counted instead, which moves a row per node and task
    and no edge.
    """
    graph = graph.checked()
    middles = _middles(graph, category)
    product = F.col("n_in").cast("decimal(19,0)") * F.col("n_out").cast("decimal(19,0)")
    total = F.coalesce(F.sum(product.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    if middles.rows > graph.limits.broadcast_rows:
        return _degrees(graph.edges).join(middles.df, "node", "left_semi").agg(total.alias("matches"))
    into, out = match_keys(graph, None, "dst", middles), match_keys(graph, None, "src", middles)
    incoming = into.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    outgoing = out.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    matched = incoming.join(outgoing, "node")
    return matched.agg(total.alias("matches"))
