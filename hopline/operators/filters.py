"""Point lookups, filters and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.model import PropertyGraph


def point_lookup(graph: PropertyGraph, node_id: int) -> DataFrame:
    """The node with this id, all columns; the predicate reaches the scan."""
    return graph.nodes.where(F.col("id") == F.lit(node_id))


def between(ts_lo: int, ts_hi: int) -> Column:
    """``ts_lo <= ts <= ts_hi``, both ends included."""
    return F.col("ts").between(ts_lo, ts_hi)


def edges_between(graph: PropertyGraph, ts_lo: int, ts_hi: int) -> DataFrame:
    return graph.edges.where(between(ts_lo, ts_hi))


def nodes_in_category(graph: PropertyGraph, category: str) -> DataFrame:
    return graph.nodes.where(F.col("category") == category)


def renamed(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Edge endpoints under the names of pattern variables."""
    return edges.select(F.col("src").alias(source), F.col("dst").alias(target))


def simple_edges(edges: DataFrame) -> DataFrame:
    """The set of ``(src, dst)`` pairs; copies of a pair collapse before the shuffle."""
    return edges.select("src", "dst").distinct()


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") == F.col("dst"))


def any_rows(df: DataFrame, limit: int) -> DataFrame:
    """Some ``limit`` rows, in no order."""
    return df.limit(limit)
