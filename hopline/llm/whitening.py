"""Whitening of embeddings with distributed block matrices.

The distinct vectors, centred and numbered, become a block matrix A; its transpose times
itself is the scatter matrix, whose eigenvectors are found locally (it is as wide as a
vector). All rows, centred and numbered, times the whitening matrix are the result.

Block matrices are formed for a stripe of rows at a time. Their product first lists the
blocks on the driver and deals them out over about the square root of the tasks; a stripe
bounds both, and the stripes' scatter matrices add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.plans.lineage import cut, scratch_path

#: Rows in a block, and blocks in a stripe.
BLOCK_ROWS = 1_024
STRIPE_BLOCKS = 4_096


def whole_numbers(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of every entry as longs; null for vectors that take no part."""
    x = vector.cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(usable, F.transform(x, lambda c: F.floor(c * scale) + F.lit(shift).cast("long")))


@dataclass(frozen=True)
class Numbered:
    """Rows with a dense ``index`` from 0, stored in one folder per stripe."""

    path: str
    rows: int
    stripe_rows: int

    def all(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)

    def stripes(self, spark) -> Iterator[DataFrame]:
        """Each stripe's rows, numbered from 0 again."""
        for s in range(-(-self.rows // self.stripe_rows)):
            part = spark.read.parquet(f"{self.path}/stripe={s}")
            yield part.withColumn("index", F.col("index") - s * self.stripe_rows)


def numbered(rows: DataFrame, name: str, stripe_rows: int) -> Numbered:
    """Rows numbered by partition and place in it; one count per partition reaches the driver."""
    spark, rows = rows.sparkSession, cut(rows)
    counts = rows.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r.p, total))
        total += r["count"]
    # the places of all partitions: a row for each, whose size is their number
    start = spark.createDataFrame(starts, "p int, start long")
    placed = rows.withColumn("p", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = placed.join(F.broadcast(start), "p").withColumn("index", F.col("start") + F.col("place")).drop("p", "start", "place")
    path = scratch_path(spark, name)
    placed.withColumn("stripe", F.floor(F.col("index") / stripe_rows)).write.partitionBy("stripe").parquet(path)
    return Numbered(path, total, stripe_rows)


def block_matrix(rows: DataFrame, vector: Column, dim: int, n: int, block_rows: int) -> BlockMatrix:
    """Rows (index, vector) as a block matrix of ``n`` x ``dim``, ``block_rows`` rows in a block.

    A block's rows are brought together by Spark and become one matrix in a task.
    """
    of = F.floor(F.col("index") / block_rows).cast("int").alias("i")
    blocks = rows.groupBy(of).agg(F.array_sort(F.collect_list(F.struct("index", vector.alias("v")))).alias("m"))
    blocks = blocks.select("i", F.flatten(F.transform("m", lambda r: r["v"])).alias("v"))
    # by rows: a transposed matrix by columns
    blocks = blocks.rdd.map(lambda b: ((b.i, 0), DenseMatrix(len(b.v) // dim, dim, b.v, True)))
    return BlockMatrix(blocks, block_rows, dim, n, dim)


def matrix_rows(a: BlockMatrix) -> DataFrame:
    """Rows (index, values) of a block matrix, without a detour through Python."""
    rows = callMLlibFunc("getIndexedRows", a.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    rows = MLUtils.convertVectorColumnsToML(rows, "vector")
    return rows.select("index", vector_to_array("vector").alias("values"))


def scatter(a: BlockMatrix) -> np.ndarray:
    """Transpose of ``a`` times ``a``. The rows of blocks are dealt out over as many tasks as
    there are, since one block of the result would otherwise gather all of them in one."""
    splits = max(1, -(-a.numRows() // a.rowsPerBlock))
    a = a.persist(StorageLevel.DISK_ONLY)  # read by the listing of blocks and by both sides
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    result = BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()
    a._java_matrix_wrapper._java_model.blocks().unpersist(False)
    return result


def projected(spark, a: BlockMatrix, ways: np.ndarray) -> BlockMatrix:
    """``a`` times a local matrix of as many rows as ``a`` has columns."""
    dim, width = ways.shape
    block = ((0, 0), DenseMatrix(dim, width, ways.ravel("F").tolist()))
    return a.multiply(BlockMatrix(spark.sparkContext.parallelize([block], 1), dim, width, dim, width))


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size, sums, and the ways rows are projected on."""

    n: int
    sums: list[int]
    ways: np.ndarray
    explained: list[float]
    identity_error: float

    def centred(self, x: str = "x") -> Column:
        """(n * x - S) / n per entry: the difference is exact, the division rounds once."""
        sums = F.array(*[F.lit(s).cast("long") for s in self.sums])
        return F.transform(F.zip_with(x, sums, lambda v, s: F.lit(self.n).cast("long") * v - s), lambda d: d.cast("double") / self.n)

    def deviation(self, x: str = "x") -> Column:
        sums = F.array(*[F.lit(s).cast("long") for s in self.sums])
        off = F.zip_with(x, sums, lambda v, s: F.lit(self.n).cast("long") * v - s)
        return F.aggregate(off, F.lit(0).cast("long"), lambda acc, d: acc + d * d)


def fit(distinct: Numbered, spark, dim: int, components: int, block_rows: int) -> Whitening:
    """The whitening of the distinct vectors ``x``; ``dim`` sums and a square matrix of that
    width reach the driver."""
    n, rows = distinct.rows, distinct.all(spark)
    sums = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    model = Whitening(n, [int(r.s) for r in sums], np.zeros((dim, 0)), [], 0.0)

    def scattered(ways: np.ndarray | None = None) -> np.ndarray:
        total = 0.0
        for s, part in enumerate(distinct.stripes(spark)):
            held = min(distinct.stripe_rows, n - s * distinct.stripe_rows)
            a = block_matrix(part, model.centred(), dim, held, block_rows)
            total = total + scatter(a if ways is None else projected(spark, a, ways))
        return total

    v = scattered() / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    # below rounding a direction has no variance to divide by
    least = max(values[0], 0.0) * dim * np.finfo(float).eps if dim else 0.0
    width = min(components, int((values > least).sum()))
    if not width:
        return model
    ways = vectors[:, :width] / np.sqrt(values[:width])
    covariance = scattered(ways) / n
    error = float(np.abs(covariance - np.eye(width)).max())
    return Whitening(n, model.sums, ways, [float(e / np.trace(v)) for e in values[:width]], error)


def whitened(
    vectors: DataFrame,
    components: int = 16,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 64,
    shift: int = 1_000_000,
    block_rows: int = BLOCK_ROWS,
    stripe_blocks: int = STRIPE_BLOCKS,
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per row and component.

    Entries become x = floor(``scale`` * c) + ``shift``. The fit list is each distinct x vector once;
    n is its size, S its sums. Components are the unit eigenvectors of its covariance (divisor n),
    by falling eigenvalue; ``whitened`` is (x - S/n) on the component over the root of its eigenvalue,
    ``deviation`` the exact sum of (n * x - S) ** 2, ``explained`` the eigenvalue's share of the trace
    and ``identity_error`` how far the covariance of the whitened fit list is from the identity.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do vectors
    of another length than the most frequent one (of equally frequent ones the longest). Repeated
    rows count once in the fit and are returned each; rows without an id are returned without one.
    There are as many components as directions with a variance above rounding, at most ``components``;
    with none (an empty table, equal vectors) the result is empty. Of equal eigenvalues any
    orthogonal vectors are returned. Whole numbers beyond 64 bits raise an arithmetic error (ANSI mode).
    Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), whole_numbers(F.col(vector_column), scale, shift).alias("x"))
    rows = rows.filter("size(x) > 0")
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim, stripe_rows = common.dim, block_rows * stripe_blocks
    rows = rows.filter(F.size("x") == dim)
    model = fit(numbered(rows.select("x").distinct(), "distinct", stripe_rows), spark, dim, components, block_rows)
    if not model.explained:
        return spark.createDataFrame([], schema)
    stored, done = numbered(rows, "rows", stripe_rows), []
    for s, part in enumerate(stored.stripes(spark)):
        held = min(stripe_rows, stored.rows - s * stripe_rows)
        a = block_matrix(part, model.centred(), dim, held, block_rows)
        values = matrix_rows(projected(spark, a, model.ways))
        named = part.select("index", "vec_id", model.deviation().alias("deviation")).join(values, "index")
        done.append(named.select("vec_id", "deviation", F.posexplode("values").alias("i", "whitened")))
    out = reduce(DataFrame.union, done)
    explained = F.array(*[F.lit(e) for e in model.explained])
    return out.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("i")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
