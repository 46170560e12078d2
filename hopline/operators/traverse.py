"""Exact-length traversals under three counting rules, and reachability.

* ``walks``: one per sequence of edges (parallel edges count apart);
* ``simple``: one per sequence of ``(src, dst)`` pairs (parallel edges are one);
* distinct ends: one per end node.

A frontier holds one row per node, with the number of walks that end there. It is
materialised after each hop, so its size is known before the next join and no hop
is computed twice; the edge table is read in place while the frontier is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.model import PropertyGraph
from hopline.operators.filters import between
from hopline.plans.lineage import Settled, settle
from hopline.plans.skew import REPEAT_CHUNK, expand, leaving, repeat_rows

#: Walk counts grow with the degree at each hop, past 64 bits on a dense graph.
WALKS = "decimal(38,0)"


def _first_step(graph: PropertyGraph, source: int, simple: bool) -> DataFrame:
    """``(node, walks)`` of the edges leaving the source, not yet merged per node."""
    first = graph.edges_at("src", [source]).select("src", "dst")
    first = first.distinct() if simple else first
    return first.select(F.col("dst").alias("node"), F.lit(1).cast(WALKS).alias("walks"))


def _step(graph: PropertyGraph, frontier: Settled, simple: bool) -> DataFrame:
    """``(node, walks)`` one edge beyond the frontier, not yet merged per node."""
    if simple:
        step = expand(graph, frontier).groupBy("src", "dst").agg(F.max("walks").alias("walks"))
    else:
        step = expand(graph, frontier, weight="walks")
    return step.select(F.col("dst").alias("node"), "walks")


def _merged(graph: PropertyGraph, step: DataFrame) -> DataFrame:
    """``(node, walks)`` with one row per node that exists."""
    return graph.existing(step.groupBy("node").agg(F.sum("walks").cast(WALKS).alias("walks")))


def _last_step(graph: PropertyGraph, source: int, hops: int, simple: bool) -> DataFrame:
    step = _first_step(graph, source, simple)
    for _ in range(hops - 1):
        step = _step(graph, settle(_merged(graph, step), graph.limits), simple)
    return step


def walk_ends(graph: PropertyGraph, source: int, hops: int, simple: bool = False) -> DataFrame:
    """``(node, walks)``: nodes at the end of a walk of exactly ``hops`` edges."""
    return _merged(graph, _last_step(graph, source, hops, simple))


def walk_count(graph: PropertyGraph, source: int, hops: int, simple: bool = False) -> DataFrame:
    """``(walks)``: how many walks of exactly ``hops`` edges leave ``source``; 0 if none.

    The last hop is summed where it is found; its ends are not brought together.
    """
    step = _last_step(graph, source, hops, simple)
    if not graph.endpoints_ok:
        step = _merged(graph, step)
    total = F.coalesce(F.sum("walks"), F.lit(0)).cast(WALKS)
    return step.agg(total.alias("walks"))


def walk_rows(graph: PropertyGraph, source: int, hops: int) -> DataFrame:
    """``(node)``: the end of every walk of exactly ``hops`` edges, one row per walk.

    From a short frontier the rows of the last hop are emitted in place, without a
    shuffle; otherwise they are counted per end node first.
    """
    if not graph.endpoints_ok:
        return repeat_rows(walk_ends(graph, source, hops), "walks")
    if hops == 1:
        return _first_step(graph, source, simple=False).select("node")
    before = settle(walk_ends(graph, source, hops - 1), graph.limits)
    step = _step(graph, before, simple=False)
    if before.head is not None and all(row.walks <= REPEAT_CHUNK for row in before.head):
        times = F.sequence(F.lit(1).cast("long"), F.col("walks").cast("long"))
        return step.select("node", F.explode(times).alias("_i")).drop("_i")
    return repeat_rows(_merged(graph, step), "walks")


def ends(graph: PropertyGraph, source: int, hops: int) -> DataFrame:
    """``(node)``: the set of nodes at the end of a walk of exactly ``hops`` edges."""
    step = graph.edges_at("src", [source])
    for hop in range(hops):
        if hop:
            step = leaving(graph, settle(reached, graph.limits))
        reached = graph.existing(step.select(F.col("dst").alias("node")).distinct())
    return reached


def end_count(graph: PropertyGraph, source: int, hops: int) -> DataFrame:
    """``(ends)``: the size of :func:`ends`."""
    return ends(graph, source, hops).agg(F.count("*").alias("ends"))


def time_slice(graph: PropertyGraph, ts_lo: int, ts_hi: int) -> PropertyGraph:
    """The subgraph of the edges inside a closed time window.

    Every hop of a traversal over it obeys the window; timestamps need not rise
    along a walk.
    """
    return graph.where_edges(between(ts_lo, ts_hi))
