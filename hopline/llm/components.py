"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.plans.lineage import cut_clean as cut

#: Rows of a step's table that a task takes at least, and how many tasks share a smaller table.
TASK_ROWS, FEW_TASKS = 100_000, 8


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """One row ``(node, root)`` per node of ``edges``; ``root`` is the smallest node reached.

    Edges count in both directions. Null ends, loops and repeated edges are
    ignored, a node that has only loops is not returned, and an empty table gives
    an empty result. Each step groups by node with map-side minima, so a hub costs
    no more than its edges; the joins that follow have one row per key on one
    side, which adaptive execution splits. Every step is checkpointed. A small table
    is worked on by few tasks, however many partitions shuffles have: a step has several
    shuffles, and each task of each leaves files.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    pairs = pairs.filter("a is not null and b is not null and a <> b")
    # a > b throughout: an edge points from the larger node to the smaller one
    pairs = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, now = None, _signature(pairs)
    while now != before and now[0]:
        tasks = max(FEW_TASKS, -(-now[0] // TASK_ROWS))
        pairs = pairs.coalesce(tasks)
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b")))
        pairs = cut(small.filter("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        before, now = now, _signature(pairs)
    tasks = max(FEW_TASKS, -(-now[0] // TASK_ROWS))
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).coalesce(tasks)
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct().coalesce(tasks))
