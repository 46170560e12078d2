"""Nearest neighbours, then one hop out from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.model import PropertyGraph
from hopline.operators.knn import nearest
from hopline.plans.lineage import settle
from hopline.plans.skew import leaving, repeat_rows


def neighbours_of_nearest(
    graph: PropertyGraph,
    corpus: DataFrame,
    query: Sequence[float],
    k: int,
    id_column: str = "id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``(id, neighbour)``: one row per edge leaving one of the ``k`` nearest nodes.

    The ``k`` ids become a literal list, so the edges are filtered in the scan.
    """
    hits = nearest(corpus, query, k, id_column, vector_column).select(F.col("id").alias("node"))
    edges = leaving(graph, settle(hits, graph.limits))
    if not graph.endpoints_ok:
        counted = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
        edges = repeat_rows(graph.existing(counted, "dst"), "n")
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))


def distinct_neighbour_count(rows: DataFrame) -> DataFrame:
    """``(neighbours)``: different end nodes among the rows."""
    return rows.agg(F.countDistinct("neighbour").alias("neighbours"))


def neighbour_count(rows: DataFrame) -> DataFrame:
    """``(neighbours)``: all rows."""
    return rows.agg(F.count("neighbour").alias("neighbours"))
