"""Exact cosine nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopline.operators.kernels import group_pairs, group_tops, task_pairs, task_tops, unit_rows
from hopline.plans.limits import DEFAULT_LIMITS, Limits


def nearest(
    corpus: DataFrame,
    query: Sequence[float],
    k: int,
    id_column: str = "id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``(id, distance)``: the ``k`` rows nearest to one query vector, ties by id.

    Rows whose vector is zero, has another length or misses an element are left
    out. Every task keeps its own ``k`` best before anything moves.
    """
    dim = len(query)
    rows = corpus.where(F.size(vector_column) == dim).select(
        F.col(id_column).cast("long").alias("id"), vector_column
    )
    unit = unit_rows(np.asarray(query, dtype=np.float64)[None, :])
    tops = block_tops(rows, np.zeros(1, dtype=np.int64), unit, k, dim)
    distance = (F.col("distance") + 0.0).alias("distance")
    return tops.select("id", distance).orderBy("distance", "id").limit(k)


def usable_queries(queries: DataFrame, query_id: str, query_vector: str, dim: int) -> DataFrame:
    """``(query_id, vector)`` of the queries of the right length; ids must be unique."""
    usable = queries.where(F.size(query_vector) == dim).select(
        F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).alias("vector")
    )
    if not usable.groupBy("query_id").count().where("count > 1").isEmpty():
        raise ValueError("query ids are not unique")
    return usable


def meet(
    asked: DataFrame,
    held: DataFrame,
    k: int,
    dim: int,
    keys: list[str],
    limits: Limits,
    run=None,
    held_bytes: int | None = None,
) -> DataFrame:
    """``(query_id, id, distance)``: the best rows of every block of queries and block of corpus.

    Queries and corpus rows with equal ``keys`` meet. Both are cut into blocks of
    bounded size by hash; every block of queries is sent to every block of corpus
    rows of its keys, in a shuffle, and a group returns ``k`` rows per query. Neither
    side passes through the driver or is broadcast. ``run`` is the function of a group,
    if it is not the exact one, over corpus rows of ``held_bytes``. The fewer blocks these
    fill, the fewer rows come back, so then queries are cut into enough groups instead.
    """
    context = asked.sparkSession.sparkContext
    most = lambda df: (
        df.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else df.count()
    ) or 0
    row_bytes = 4 * dim + 16
    n_asked, n_held = most(asked), most(held)
    rows = max(1, min(limits.query_rows, limits.block_bytes // row_bytes))
    asked_blocks = max(1, -(-n_asked // rows))
    held_blocks = max(1, -(-n_held // max(1, limits.block_bytes // (held_bytes or row_bytes))))
    if held_bytes:
        asked_blocks = max(asked_blocks, min(-(-4 * context.defaultParallelism // held_blocks), n_asked // 500))
    elif not keys:  # enough groups for all tasks, unless the corpus is tiny
        held_blocks = max(held_blocks, min(context.defaultParallelism, n_held // 500))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    asked = asked.withColumn("_q", mine(asked_blocks, "query_id")).withColumn("_c", every(held_blocks))
    held = held.withColumn("_c", mine(held_blocks, "id", "vector")).withColumn("_q", every(asked_blocks))
    # one number per pair of blocks: rows are then sorted by their prefix alone
    by = [*keys, (F.col("_q").cast("long") * held_blocks + F.col("_c")).alias("_g")]
    return (
        asked.groupBy(*by)
        .cogroup(held.groupBy(*by))
        .applyInArrow(run or group_tops(k, dim), "query_id long, id long, distance double")
    )


def nearest_many(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    id_column: str = "id",
    vector_column: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(query_id, id, distance, rank)``: the ``k`` nearest rows for every query.

    Distances never leave the task that forms them; see :func:`meet`.
    """
    rows = corpus.where(F.size(vector_column) == dim).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")
    )
    asked = usable_queries(queries, query_id, query_vector, dim)
    return ranked(meet(asked, rows, k, dim, [], limits), k)


def meet_chosen(
    asked: DataFrame, held: DataFrame, chosen: DataFrame, pairs: int, k: int, dim: int, limits: Limits
) -> DataFrame:
    """``(query_id, id, distance)``: the best of the ``chosen`` pairs ``(query_id, id)``.

    Queries and rows are cut into blocks as in :func:`meet` and sent to the blocks of the other
    side, where their pairs come as ids: a vector moves once per block, not once per pair.
    """
    parallel = asked.sparkSession.sparkContext.defaultParallelism
    rows = max(1, limits.block_bytes // (4 * dim + 16))
    asked_blocks = max(1, -(-asked.count() // rows))
    groups = max(2 * parallel, -(-16 * pairs // limits.block_bytes))
    held_blocks = max(1, -(-held.count() // rows), -(-groups // asked_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q, c = mine(asked_blocks, "query_id").alias("_q"), mine(held_blocks, "id").alias("_c")
    asked = asked.select("query_id", "vector", q, every(held_blocks).alias("_c"))
    asked = asked.where("query_id is not null")
    # an empty vector, as nulls are slow to write as Arrow lists
    no_query, no_vector = F.lit(None).cast("long"), F.array().cast(held.schema["vector"].dataType)
    held = held.where("id is not null").select(
        no_query.alias("query_id"), "id", "vector", every(asked_blocks).alias("_q"), c
    )
    chosen = chosen.where("query_id is not null and id is not null")
    both = held.unionByName(chosen.select("query_id", "id", no_vector.alias("vector"), q, c))
    by = (F.col("_q").cast("long") * held_blocks + F.col("_c")).alias("_g")
    return (
        asked.groupBy(by)
        .cogroup(both.groupBy(by))
        .applyInArrow(group_pairs(k, dim), "query_id long, id long, distance double")
    )


def block_tops(rows: DataFrame, ids, units, k: int, dim: int) -> DataFrame:
    """``(query_id, id, distance)``: every task's best rows for a query vector of the caller."""
    context = rows.sparkSession.sparkContext
    run = task_tops(context.broadcast(ids), context.broadcast(units), k, dim)
    return rows.mapInArrow(run, "query_id long, id long, distance double")


def ranked(tops: DataFrame, k: int) -> DataFrame:
    """Merge the blocks' best rows into the ``k`` best per query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    best = tops.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(
        "query_id", "id", (F.col("distance") + 0.0).alias("distance"), F.col("rank").cast("long")
    )


def pair_distances(pairs: DataFrame, dim: int) -> DataFrame:
    """``(query_id, id, distance)`` of rows ``(query_id, asked, id, vector)``."""
    given = pairs.select("query_id", "asked", "id", "vector")
    return given.mapInArrow(task_pairs(dim), "query_id long, id long, distance double")
