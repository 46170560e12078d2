"""Approximate nearest neighbours: a corpus split into cells around centroids.

Clustering gives the centroids; each row is stored in the folders of its nearest centroids;
a query reads the few cells whose centroids are nearest to it. An index may also hold short
codes of the rows: a probe then compares codes, and only the best few rows in full.

Cells have numbers that are never used again. New rows are appended to the cells; a crowded
cell is replaced by two new ones. What cells there are is written last, as a new version of
the table of centroids, so a job that fails leaves the index as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopline.operators.kernels import (
    group_code_tops,
    group_means,
    task_cells,
    task_code_tops,
    task_probes,
    task_stretches,
    task_units,
    unit_rows,
)
from hopline.operators.knn import meet, meet_chosen, nearest, pair_distances, ranked, usable_queries
from hopline.plans.limits import DEFAULT_LIMITS, Limits
from hopline.plans.lineage import settle
from hopline.plans.skew import in_list

#: Cell of rows that have no direction: zero vectors and vectors of another length.
NO_CELL = -1

#: Folders, beside the cells, of what is needed to open an index again.
CENTROIDS, CODES = "_centroids", "_codes"

#: Different values of a code's byte.
CODE_VALUES = 256


@dataclass(frozen=True)
class CellIndex:
    """A corpus written ``partitionBy("cell")`` and its centroids, one row per cell.

    ``copies`` is the number of cells a row is stored in; ``codes`` the values that the
    bytes of a row's code stand for, if it has one; ``numbers`` the cells' numbers.
    """

    path: str
    centroids: np.ndarray
    dim: int
    copies: int = 1
    codes: np.ndarray | None = None
    numbers: np.ndarray | None = None
    version: int = 1

    def __post_init__(self):
        if self.numbers is None:
            object.__setattr__(self, "numbers", np.arange(len(self.centroids)))

    @property
    def cells(self) -> int:
        return len(self.centroids)

    @property
    def known(self) -> tuple:
        """What tasks get by broadcast: plain arrays, since executors need not have this package."""
        return self.numbers, self.centroids, self.codes

    def entries(self, spark: SparkSession) -> DataFrame:
        """``(id, embedding, nth, code, cell)``: ``copies`` rows per row of the corpus."""
        stored = spark.read.parquet(self.path)
        if self.version == 1:
            return stored
        return stored.where(F.col("cell").isin([NO_CELL, *map(int, self.numbers)]))

    def corpus(self, spark: SparkSession) -> DataFrame:
        """``(id, embedding, cell)``, every row once."""
        return self.entries(spark).where("nth = 0").select("id", "embedding", "cell")

    def probe(self, unit: np.ndarray, nprobe: int) -> np.ndarray:
        """Per unit query vector, the ``nprobe`` cells with the nearest centroids."""
        nearest_at = np.argsort(-(unit @ self.centroids.T), axis=1, kind="stable")[:, :nprobe]
        return self.numbers[nearest_at]


def _trainable(vector: str, dim: int):
    """Whether a vector is complete and has a direction."""
    complete = ~F.exists(vector, lambda x: x.isNull())
    return (F.size(vector) == dim) & complete & F.exists(vector, lambda x: x != 0)


def _rows(corpus: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return corpus.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<float>").alias("embedding"),
    )


ENTRIES = "id long, embedding array<float>, nth int, code binary, cell int"


def _write(entries: DataFrame, path: str, mode: str) -> None:
    """Entries by cell, in the order of ids. A crowded cell is split over writing tasks."""
    dealt = entries.hint("rebalance", "cell").sortWithinPartitions("cell", "id")
    dealt.write.mode(mode).partitionBy("cell").parquet(path)


def _write_version(spark: SparkSession, index: CellIndex) -> None:
    stored = [
        (int(number), index.dim, index.copies, [float(x) for x in row])
        for number, row in zip(index.numbers, index.centroids)
    ]
    kept = spark.createDataFrame(stored, "cell int, dim int, copies int, centroid array<double>")
    path = f"{index.path}/{CENTROIDS}/version={index.version}"
    kept.coalesce(1).write.mode("overwrite").parquet(path)


def _learn_codes(rows: DataFrame, index: CellIndex, parts: int, sample: int) -> np.ndarray:
    """What the bytes of a code stand for, from at most ``sample`` rows, the first by hash.

    One task per byte; one row of ``CODE_VALUES`` short vectors per byte comes back.
    """
    if index.dim % parts:
        raise ValueError(f"vectors of {index.dim} elements cannot be cut into {parts} equal parts")
    spark = rows.sparkSession
    some = rows.where(_trainable("embedding", index.dim))
    some = some.orderBy(F.xxhash64("id"), "id").limit(sample)
    run = task_stretches(spark.sparkContext.broadcast(index.known), index.dim, parts)
    width = index.dim // parts
    learned = (
        some.mapInArrow(run, "part int, rows binary")
        .repartition(parts, "part")  # few bytes, much work
        .groupBy("part")
        .applyInArrow(group_means("part", CODE_VALUES, width), "part int, values array<double>")
    )
    values = [r["values"] for r in learned.orderBy("part").collect()]
    return np.array(values, dtype=np.float64).reshape(len(values), -1, width)


def build_cells(
    corpus: DataFrame,
    path: str,
    cells: int,
    dim: int,
    id_column: str = "id",
    vector_column: str = "embedding",
    max_iter: int = 10,
    seed: int = 42,
    train_fraction: float = 1.0,
    copies: int = 1,
    code_bytes: int = 0,
    code_sample: int = 20_000,
) -> CellIndex:
    """Cluster the corpus by angle and write it one folder per cell.

    ``train_fraction`` thins the rows the centroids are learned from, ``code_sample`` bounds
    the rows the codes are learned from; all rows are assigned and written. A row is stored
    in its ``copies`` nearest cells, with a code of ``code_bytes`` bytes if that is not 0.
    """
    rows = _rows(corpus, id_column, vector_column)
    training = rows.sample(train_fraction, seed=seed) if train_fraction < 1.0 else rows
    features = training.where(_trainable("embedding", dim)).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    model = KMeans(
        k=cells, distanceMeasure="cosine", initMode="random", maxIter=max_iter, seed=seed
    )
    # Every iteration reads the features again; on disk they are not decoded each time.
    features = features.persist(StorageLevel.DISK_ONLY)
    try:
        centroids = unit_rows(np.array(model.fit(features).clusterCenters(), dtype=np.float64))
    finally:
        features.unpersist()
    spark = corpus.sparkSession
    index = CellIndex(path, centroids, dim, min(copies, len(centroids)))
    if code_bytes:
        index = replace(index, codes=_learn_codes(rows, index, code_bytes, code_sample))
    run = task_cells(spark.sparkContext.broadcast(index.known), dim, NO_CELL, index.copies)
    _write(rows.mapInArrow(run, ENTRIES), path, "overwrite")
    if code_bytes:
        stored = [(m, [float(x) for x in part.ravel()]) for m, part in enumerate(index.codes)]
        kept = spark.createDataFrame(stored, "part int, values array<double>")
        kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/{CODES}")
    _write_version(spark, index)
    return index


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def open_cells(spark: SparkSession, path: str) -> CellIndex:
    """The newest version of an index that is stored. One row per cell and byte of a code is read."""
    stored = spark.read.parquet(f"{path}/{CENTROIDS}")
    version = stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).orderBy("cell").collect()
    codes = None
    if _exists(spark, f"{path}/{CODES}"):
        values = [r["values"] for r in spark.read.parquet(f"{path}/{CODES}").orderBy("part").collect()]
        codes = np.array(values, dtype=np.float64).reshape(len(values), -1, rows[0].dim // len(values))
    centroids = np.array([r.centroid for r in rows], dtype=np.float64)
    numbers = np.array([r.cell for r in rows])
    return CellIndex(path, centroids, rows[0].dim, rows[0].copies, codes, numbers, version)


def append_cells(
    index: CellIndex,
    batch: DataFrame,
    id_column: str = "id",
    vector_column: str = "embedding",
    crowded: float = 2.0,
    sample: int = 20_000,
) -> CellIndex:
    """Add rows to a stored index; returns the index with the cells it has then.

    Rows go to the nearest of the present cells. A cell that then holds more than ``crowded``
    times the average is replaced by two, around centres of at most about ``sample`` of its
    rows; only its own rows are written again. Its old folder stays for those who opened the
    index before. One writer at a time; a batch that is delivered twice is stored twice.
    """
    spark = batch.sparkSession
    context = spark.sparkContext
    run = task_cells(context.broadcast(index.known), index.dim, NO_CELL, index.copies)
    rows = _rows(batch, id_column, vector_column).mapInArrow(run, ENTRIES)
    _write(rows, index.path, "append")
    counted = index.entries(spark).where(F.col("cell") != NO_CELL).groupBy("cell").count()
    sizes = {r.cell: r["count"] for r in counted.collect()}  # a row per cell
    most = crowded * sum(sizes.values()) / max(1, index.cells)
    full = sorted(c for c, n in sizes.items() if n > most)
    if not full:
        return index
    entries = index.entries(spark).where(F.col("cell").isin(full))
    share = F.element_at(F.create_map(*[F.lit(x) for c in full for x in (c, min(1.0, sample / sizes[c]))]), F.col("cell"))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)
    some = entries.where(drawn).select("cell", "embedding").mapInArrow(task_units(index.dim), "cell int, rows binary")
    halves = some.groupBy("cell").applyInArrow(group_means("cell", 2, index.dim), "cell int, values array<double>")
    children, number = {}, int(index.numbers.max()) + 1
    numbers = [n for n in index.numbers.tolist() if n not in full]
    centroids = [c for n, c in zip(index.numbers.tolist(), index.centroids) if n not in full]
    for r in halves.orderBy("cell").collect():
        pair = unit_rows(np.array(r["values"], dtype=np.float64).reshape(-1, index.dim))
        if len(pair) < 2 or np.isnan(pair).any() or np.allclose(pair[0], pair[1]):
            numbers.append(r.cell)  # nothing but copies of one vector: it stays
            centroids.append(index.centroids[list(index.numbers).index(r.cell)])
            continue
        children[r.cell] = (number, number + 1)
        numbers += children[r.cell]
        centroids += list(pair)
        number += 2
    if not children:
        return index
    grown = replace(
        index, centroids=np.array(centroids), numbers=np.array(numbers), version=index.version + 1
    )
    run = task_cells(context.broadcast(grown.known), index.dim, NO_CELL, among=children)
    moved = entries.where(F.col("cell").isin(list(children))).select("id", "embedding", "nth", "cell")
    _write(moved.mapInArrow(run, ENTRIES), index.path, "append")
    _write_version(spark, grown)
    return grown


def _once(found: DataFrame, index: CellIndex) -> DataFrame:
    """A row may come from several cells; its distance is the same or, of codes, the least counts."""
    if index.copies == 1:
        return found
    return found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))


def nearest_in_cells(
    spark: SparkSession,
    index: CellIndex,
    query: Sequence[float],
    k: int,
    nprobe: int,
    rerank: int | None = None,
) -> DataFrame:
    """``(id, distance)`` from the ``nprobe`` nearest cells; other cells are not read.

    With ``rerank`` the codes of those cells are compared, and only the ``rerank`` rows with
    the nearest codes in full; their ids pass through the driver.
    """
    unit = unit_rows(np.asarray(query, dtype=np.float64)[None, :])
    wanted = [int(c) for c in index.probe(np.nan_to_num(unit), nprobe)[0]]
    entries = index.entries(spark).where(F.col("cell").isin(wanted))
    if rerank is None:
        # in full: the copies of a row have equal distances
        found = nearest(entries, query, k * index.copies)
        if index.copies == 1:
            return found
        return found.distinct().orderBy("distance", "id").limit(k)
    if index.codes is None:
        raise ValueError("the index has no codes")
    run = task_code_tops(spark.sparkContext.broadcast(index.known), unit, rerank)
    codes = entries.where("code is not null").select("id", F.col("code").alias("vector"), "cell")
    tops = codes.mapInArrow(run, "id long, distance double")
    best = tops.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(rerank)
    ids = [r.id for r in best.collect()]
    return nearest(index.corpus(spark).where(in_list("id", ids)), query, k)


def candidates_in_cells(
    spark: SparkSession,
    index: CellIndex,
    queries: DataFrame,
    nprobe: int,
    rerank: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(query_id, id)``: the ``rerank`` rows of the probed cells with the nearest codes."""
    if index.codes is None:
        raise ValueError("the index has no codes")
    held = index.entries(spark).where("code is not null")
    held = held.select("id", F.col("code").alias("vector"), "cell")
    asked = usable_queries(queries, query_id, query_vector, index.dim)
    known = spark.sparkContext.broadcast(index.known)
    run = group_code_tops(rerank, index.dim, known, nprobe, distinct=index.copies > 1)
    found = meet(asked, held, rerank, index.dim, [], limits, run, held_bytes=len(index.codes) + 16)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    best = _once(found.repartition("query_id"), index).withColumn("_nth", F.row_number().over(order))
    return best.where(F.col("_nth") <= rerank).select("query_id", "id")


def _probing(spark: SparkSession, index: CellIndex, asked: DataFrame, nprobe: int) -> DataFrame:
    run = task_probes(spark.sparkContext.broadcast(index.known), index.dim, nprobe)
    schema = f"query_id long, vector {asked.schema['vector'].dataType.simpleString()}, cell int"
    return asked.mapInArrow(run, schema)


def compared_in_full(
    spark: SparkSession,
    index: CellIndex,
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(query_id, id, distance, rank)``: the ``k`` nearest of every query's candidates, exactly.

    The corpus is read in place while there are few enough candidates to broadcast.
    """
    asked = usable_queries(queries, query_id, query_vector, index.dim)
    chosen = settle(candidates, limits)
    held = index.corpus(spark).select("id", F.col("embedding").alias("vector"))
    if chosen.rows > limits.broadcast_rows:
        held = held.where(F.size("vector") == index.dim)
        return ranked(meet_chosen(asked, held, chosen.df, chosen.rows, k, index.dim, limits), k)
    asked = asked.select("query_id", F.col("vector").alias("asked"))
    if asked.count() <= limits.query_rows:
        asked = F.broadcast(asked)
    pairs = held.join(F.broadcast(chosen.df), "id")
    return ranked(pair_distances(pairs.join(asked, "query_id"), index.dim), k)


def nearest_many_in_cells(
    spark: SparkSession,
    index: CellIndex,
    queries: DataFrame,
    k: int,
    nprobe: int,
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    limits: Limits = DEFAULT_LIMITS,
    rerank: int | None = None,
) -> DataFrame:
    """``(query_id, id, distance, rank)``: each query against its ``nprobe`` nearest cells.

    With ``rerank`` codes are compared, and only so many rows per query in full.
    """
    if rerank is not None:
        chosen = candidates_in_cells(spark, index, queries, nprobe, rerank, query_id, query_vector, limits)
        return compared_in_full(spark, index, queries, chosen, k, query_id, query_vector, limits)
    held = index.entries(spark).select("id", F.col("embedding").alias("vector"), "cell")
    held = held.where(F.size("vector") == index.dim)
    asked = usable_queries(queries, query_id, query_vector, index.dim)
    found = meet(_probing(spark, index, asked, nprobe), held, k, index.dim, ["cell"], limits)
    return ranked(_once(found, index), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """``(query_id, recall)``: the share of each query's exact rows that were found."""
    found = approximate.select("query_id", "id", F.lit(1).alias("found"))
    return (
        exact.select("query_id", "id")
        .join(found, ["query_id", "id"], "left")
        .groupBy("query_id")
        .agg((F.count("found") / F.count("*")).alias("recall"))
    )
