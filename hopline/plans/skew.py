"""Joins of the whole edge table with a key table, safe for hub keys.

A small key table is broadcast, so the edge table is read in place and a hub's
edges stay spread over the scan. A large key table needs a shuffle; then the hubs
take their own route. A hub is a key with more than 1/``hub_share`` of all rows,
so by counting alone there are at most ``hub_share`` of them and their list may
always be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.plans.lineage import Settled, cut
from hopline.plans.limits import DEFAULT_LIMITS, Limits


def hub_table(edges: DataFrame, key: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """``(hub, splits)``: keys too heavy for one task and how many tasks they need."""
    threshold = max(edges.count() // limits.hub_share, limits.hub_rows)
    counted = edges.groupBy(F.col(key).alias("hub")).agg(F.count("*").alias("n"))
    hubs = counted.where(F.col("n") > threshold)
    return cut(hubs.select("hub", F.ceil(F.col("n") / threshold).cast("int").alias("splits")))


#: Spark picks the first rows of a window per task only up to this many.
TASK_FIRST_ROWS = 1_000
#: Parts a key is cut into for picking more first rows than that.
FIRST_ROW_PARTS = 64


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of every key by ``order``, with a hot key never sorted in one task.

    More rows than Spark's own per-task pick allows are first picked in parts of the
    key, dealt out by the task a row comes from.
    """
    ordered = [F.col(c) for c in order]
    if n > TASK_FIRST_ROWS:
        part = F.pmod(F.spark_partition_id(), F.lit(FIRST_ROW_PARTS))
        own = Window.partitionBy(*keys, "_part").orderBy(*ordered)
        df = df.withColumn("_part", part).withColumn("_nth", F.row_number().over(own))
        df = df.where(F.col("_nth") <= n).drop("_part", "_nth")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def in_list(key: str, ids: list[int]) -> Column:
    """``key IN (ids)``, parsed in one go instead of built value by value."""
    return F.expr(f"`{key}` in ({', '.join(f'{i}L' for i in ids)})") if ids else F.lit(False)


def expand(graph, frontier: Settled, weight: str | None = None) -> DataFrame:
    """``(src, dst)`` edges leaving the frontier's ``node`` column, with its columns.

    A hub's identical ``(src, dst)`` edges may come as one row, which then has their
    number multiplied into the ``weight`` column. The graph's hubs are looked up only
    when the frontier is too large to broadcast.
    """
    if frontier.rows <= graph.limits.broadcast_rows:
        literals = frontier.literals("node")
        pairs = graph.edges if literals is None else graph.edges_at("src", literals)
        pairs = pairs.select("src", "dst")
        return pairs.join(F.broadcast(frontier.df), F.col("src") == F.col("node"))

    hub = F.broadcast(graph.split_hubs())
    cold_edges, hot_edges = graph.cold_and_hot()
    cold = cold_edges.select("src", "dst").join(frontier.df, F.col("src") == F.col("node"))
    # Copies of one hub edge collapse map-side; what is left is spread by dst.
    hot_pairs = (
        hot_edges.select("src", "dst")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("decimal(19,0)").alias("copies"))
        .join(hub, F.col("src") == F.col("hub"))
        .withColumn("salt", F.expr("pmod(xxhash64(dst), splits)"))
        .drop("hub", "splits")
    )
    hot_frontier = (
        frontier.df.join(hub, F.col("node") == F.col("hub"))
        .withColumn("salt", F.explode(F.expr("sequence(0L, splits - 1L)")))
        .drop("hub", "splits")
    )
    e, f = hot_pairs.alias("e"), hot_frontier.alias("f")
    same = (F.col("e.src") == F.col("f.node")) & (F.col("e.salt") == F.col("f.salt"))
    carried = []
    for name, kind in frontier.df.dtypes:
        value = F.col(f"f.{name}")
        if name == weight:
            value = (value * F.col("e.copies")).cast(kind).alias(name)
        carried.append(value)
    return cold.unionByName(e.join(f, same).select("e.src", "e.dst", *carried))


def leaving(graph, keys: Settled) -> DataFrame:
    """``(src, dst)`` of every edge whose source is in the ``node`` column of ``keys``."""
    if keys.rows <= graph.limits.broadcast_rows:
        return match_keys(graph, None, "src", keys).select("src", "dst")
    cold, hot = (part.select("src", "dst") for part in graph.cold_and_hot())
    is_key = F.col("src") == F.col("node")
    hub = F.broadcast(graph.split_hubs())
    hot_keys = keys.df.join(hub, F.col("node") == F.col("hub"), "left_semi")
    return cold.join(keys.df, is_key, "left_semi").unionByName(
        hot.join(F.broadcast(hot_keys.select("node").distinct()), is_key, "left_semi")
    )


def match_keys(
    graph, edges: DataFrame | None, key: str, keys: Settled, how: str = "left_semi"
) -> DataFrame:
    """Rows of ``edges`` whose ``key`` is (``left_semi``) or is not (``left_anti``) in ``keys``.

    None stands for all edges of the graph; those of a short list of keys then come from
    the graph's layout by that key. ``keys`` has a ``node`` column without nulls. Hub keys
    of a large list are compared with a broadcast of the hubs in it, all others in a
    shuffled join.
    """
    if edges is None:
        few = keys.literals("node")
        if few is not None and how == "left_semi":
            return graph.edges_at(key, few)
        edges = graph.edges
    is_key = F.col(key) == F.col("node")
    if keys.rows <= graph.limits.broadcast_rows:
        literals = keys.literals("node")
        if literals is None:
            return edges.join(F.broadcast(keys.df), is_key, how)
        found = in_list(key, literals)
        return edges.where(found if how == "left_semi" else ~found)
    hub = graph.hubs(key)
    is_hub = F.col(key) == F.col("hub")
    hot_keys = keys.df.join(F.broadcast(hub), F.col("node") == F.col("hub"), "left_semi")
    hot_keys = F.broadcast(hot_keys.select("node").distinct())
    cold = edges.join(F.broadcast(hub), is_hub, "left_anti").join(keys.df, is_key, how)
    hot = edges.join(F.broadcast(hub), is_hub, "left_semi").join(hot_keys, is_key, how)
    return cold.unionByName(hot)


#: Rows one generator call may emit; larger repeats are split over tasks.
REPEAT_CHUNK = 1_000_000


def repeat_rows(df: DataFrame, times: str, chunk: int = REPEAT_CHUNK) -> DataFrame:
    """Each row ``times`` times over; a heavy row is cut into chunks that are spread out."""
    keep = [c for c in df.columns if c != times]
    total = F.col(times).cast("long")
    chunked = df.select(
        *keep,
        total.alias("_n"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / chunk))).alias("_c"),
    )
    size = F.least(F.lit(chunk).cast("long"), F.col("_n") - F.col("_c") * chunk)
    return (
        chunked.select(*keep, "_c", size.alias("_size"))
        .repartition(*keep, "_c")
        .select(*keep, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size"))).alias("_i"))
        .drop("_i")
    )
