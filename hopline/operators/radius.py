"""Exact nearest neighbours of many queries, skipping whole blocks of rows by their radius.

Rows are dealt out once by direction and packed into blocks; a block keeps its mean direction
and the widest angle of a row to it, its radius. A row of the block is at least the angle
between query and mean less the radius away from the query (angles obey the triangle
inequality). A first pass compares each query with the blocks of its own direction only,
which bounds its k-th distance; the second skips all blocks that must lie beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.operators.cells import NO_CELL, _rows, _trainable
from hopline.operators.kernels import (
    group_means,
    matrix,
    task_block_tops,
    task_blocks,
    task_cells,
    task_units,
    unit_rows,
)
from hopline.operators.knn import ranked, usable_queries
from hopline.plans.limits import DEFAULT_LIMITS, Limits
from hopline.plans.lineage import cut

BLOCKS = "cell int, ids binary, rows binary, middle binary, widest double"


@dataclass(frozen=True)
class Blocks:
    """A corpus packed by direction. ``ways`` are the directions it was dealt out by."""

    df: DataFrame
    ways: np.ndarray
    dim: int


def pack_by_direction(
    corpus: DataFrame,
    dim: int,
    cells: int = 64,
    id_column: str = "id",
    vector_column: str = "embedding",
    block_rows: int = 1_024,
    sample: int = 20_000,
    tasks: int | None = None,
) -> Blocks:
    """Deal the corpus out by ``cells`` directions, learned from at most ``sample`` rows (the
    first by hash), and pack it. The one shuffle of the corpus; crowded directions are split.

    Rows whose vector is zero, has another length or misses an element are left out.
    """
    rows = _rows(corpus, id_column, vector_column)
    context = corpus.sparkSession.sparkContext
    some = rows.where(_trainable("embedding", dim)).orderBy(F.xxhash64("id"), "id").limit(sample)
    packed = some.select(F.lit(0).alias("cell"), "embedding").mapInArrow(task_units(dim), "cell int, rows binary")
    learned = packed.groupBy("cell").applyInArrow(group_means("cell", cells, dim), "cell int, values array<double>")
    found = [r["values"] for r in learned.collect()]
    ways = unit_rows(np.array(found, dtype=np.float64).reshape(-1, dim))
    ways = ways[~np.isnan(ways).any(axis=1)]
    if not len(ways):
        return Blocks(cut(corpus.sparkSession.createDataFrame([], BLOCKS)), ways, dim)
    known = context.broadcast((np.arange(len(ways)), ways))
    entries = "id long, embedding array<float>, nth int, code binary, cell int"
    dealt = rows.mapInArrow(task_cells(known, dim, NO_CELL), entries).where(F.col("cell") != NO_CELL)
    order = ["cell", F.xxhash64("id", "embedding")]
    dealt = dealt.repartitionByRange(tasks, *order) if tasks else dealt.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions("cell").select("id", "embedding", "cell")
    return Blocks(cut(dealt.mapInArrow(task_blocks(dim, block_rows), BLOCKS)), ways, dim)


def _query_blocks(asked: DataFrame, dim: int, limits: Limits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries, a bounded block at a time."""
    rows = max(1, min(limits.query_rows, limits.block_bytes // (4 * dim + 16)))
    blocks = max(1, -(-asked.count() // rows))
    of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for b in range(blocks):
        table = asked.where(of == b).toArrow()
        units = unit_rows(matrix(table.column("vector"), dim))
        usable = ~np.isnan(units).any(axis=1)
        yield table.column("query_id").to_numpy()[usable], units[usable]


TOPS = "query_id long, id long, distance double"


def _passes(blocks: Blocks, asked: DataFrame, k: int, limits: Limits) -> Iterator[tuple]:
    """Per block of queries, what the second pass needs: the queries and bounds of their k-th distance."""
    context = blocks.df.sparkSession.sparkContext
    for ids, units in _query_blocks(asked, blocks.dim, limits):
        if not len(ids) or not len(blocks.ways):
            continue
        own = np.argmax(units @ blocks.ways.T, axis=1)
        first = context.broadcast((ids, units, own, None))
        tops = ranked(blocks.df.mapInArrow(task_block_tops(first, k, blocks.dim), TOPS), k)
        bounds = np.full(len(ids), np.inf)
        order = np.argsort(ids)
        kth = tops.where(F.col("rank") == k).select("query_id", "distance").toArrow()
        at = order[np.searchsorted(ids[order], kth.column("query_id").to_numpy())]
        bounds[at] = kth.column("distance").to_numpy()
        yield context.broadcast((ids, units, None, bounds))


def nearest_many_in_blocks(
    blocks: Blocks,
    queries: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(query_id, id, distance, rank)``: the ``k`` nearest rows for every query, exactly; ties by id.

    Queries are broadcast a bounded block at a time; the packed corpus is read in place, twice
    for each, and a task sends at most ``k`` rows per query.
    """
    asked = usable_queries(queries, query_id, query_vector, blocks.dim)
    parts = [
        blocks.df.mapInArrow(task_block_tops(given, k, blocks.dim), TOPS)
        for given in _passes(blocks, asked, k, limits)
    ]
    if not parts:
        return ranked(blocks.df.sparkSession.createDataFrame([], TOPS), k)
    return ranked(reduce(DataFrame.unionByName, parts), k)


def compared_pairs(
    blocks: Blocks,
    queries: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(compared, pairs)``: pairs of query and row that the second pass compares, of how many."""
    asked = usable_queries(queries, query_id, query_vector, blocks.dim)
    counts = "compared long, pairs long"
    parts = [
        blocks.df.mapInArrow(task_block_tops(given, k, blocks.dim, count=True), counts)
        for given in _passes(blocks, asked, k, limits)
    ]
    none = blocks.df.sparkSession.createDataFrame([(0, 0)], counts)
    total = reduce(DataFrame.unionByName, parts, none)
    return total.agg(F.sum("compared").alias("compared"), F.sum("pairs").alias("pairs"))
