"""Exact search for the highest inner products: histograms of all scores locate every k-th value.

Vectors become whole numbers, so scores are whole numbers too. Every query's scores lie in
one range of known width. A round scores everything, counts the scores per bin of what is
left of each query's range, adds the counts up over all tasks and keeps the one bin that
holds the k-th highest score; the next round divides that bin. When a bin is a single value,
that value is the query's threshold. A last pass keeps the scores above it, and of those
equal to it the rows with the smallest ids.

Vectors are packed into blocks where they lie, so repeated vectors and ids cannot fill one
task. Blocks of queries and of rows meet by two bucket numbers in a shuffle; nothing but
counts and the largest length of a vector reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.plans.lineage import cut

#: Bits of the score that one round settles at most; a query has so many bins at a time.
ROUND_BITS = 8
#: Scores formed at a time in a task.
AT_ONCE = 2_000_000
LEAST, MOST = -(2**63), 2**63 - 1


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as longs; null for vectors that take no part."""
    x = vector.cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(usable, F.transform(x, lambda c: F.floor(c * scale)))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _top(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


def packed(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows (vec_id, x) as blocks (block, dim, ids, known, x, length): vectors of one number of
    components, in as few bytes a component as they need; ``length`` is the longest one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        done = 0
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("x")).to_numpy()
            for dim in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == dim)
                step = max(1, min(most_rows, most_bytes // (8 * dim + 16)))
                for first in range(0, len(here), step):
                    at = pa.array(here[first : first + step])
                    x = _matrix(batch.column("x").take(at), dim)
                    ids = batch.column("vec_id").take(at)
                    top = _top(x)
                    kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or top < 1 << (8 * int(t[2]) - 1))
                    length = float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task + done]), pa.array([dim], pa.int32()), pa.array([ids.fill_null(0).to_numpy().tobytes()], pa.binary()),
                         pa.array([ids.is_valid().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([length])],
                        names=["block", "dim", "ids", "known", "kind", "x", "length"],
                    )
                    done += 1

    return rows.select("vec_id", "x").mapInArrow(run, "block long, dim int, ids binary, known binary, kind string, x binary, length double")


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products, exactly; beyond 64 bits the nearest long."""
    most = queries.shape[1] * _top(queries) * _top(rows)
    if most < 2**53:  # every partial sum is a whole number that the float holds
        kind = np.float32 if most < 2**24 else np.float64
        return queries.astype(kind) @ rows.astype(kind).T
    if most < 2**63:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    exact = queries.astype(object) @ rows.astype(object).T
    return np.vectorize(lambda s: min(max(s, LEAST), MOST), otypes=[np.int64])(exact)


class _Group:
    """Queries and blocks of rows that meet in one task."""

    def __init__(self, queries: pa.Table, blocks: pa.Table):
        self.n = queries.num_rows if blocks.num_rows else 0
        if not self.n:
            return
        column = lambda name: queries.column(name).to_numpy()
        self.keys, self.ids, self.need = column("key"), column("vec_id"), column("need")
        self.base = column("base").view(np.uint64)
        self.x = _matrix(queries.column("x"), blocks.column("dim")[0].as_py())
        self.blocks = blocks

    def scored(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, scores, the rows' ids, whether a row has an id), piece by piece."""
        dim = self.x.shape[1]
        for r in range(self.blocks.num_rows):
            of = {c: self.blocks.column(c)[r].as_py() for c in ("ids", "known", "kind", "x")}
            ids, known = np.frombuffer(of["ids"], np.int64), np.frombuffer(of["known"], bool)
            rows = np.frombuffer(of["x"], of["kind"]).reshape(len(ids), dim)
            step = max(1, AT_ONCE // len(ids))
            for first in range(0, self.n, step):
                part = slice(first, min(first + step, self.n))
                yield part, products(self.x[part], rows), ids, known

    def own(self, part: slice, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) places in a piece that hold a query's own row."""
        order = np.argsort(ids, kind="stable")
        mine = self.ids[part]
        low, high = (np.searchsorted(ids, mine, side, sorter=order) for side in ("left", "right"))
        query = np.repeat(np.arange(len(mine)), high - low)
        row = order[np.arange(len(query)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]
        return query[known[row]], row[known[row]]


def _places(scores: np.ndarray, bound: int) -> np.ndarray:
    """Scores as unsigned numbers from 0: the place in the range from -bound on."""
    return scores.astype(np.int64).view(np.uint64) + np.uint64(bound)


def _from(scores: np.ndarray, base: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Where scores reach their query's base. Compared in 64 bits: an exact integer if floats hold it."""
    if bound < 2**52 and scores.dtype != np.int64:
        return np.nonzero(scores >= (base.astype(np.int64) - bound).astype(scores.dtype)[:, None])
    return np.nonzero(_places(scores, bound) >= base[:, None])


def _counts(shift: int, bits: int, bound: int):
    """One round in a group: rows (key, bin, n). Bins below a group's own k-th value are left
    out: the k-th value of all is no lower."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        group, bins = _Group(queries, blocks), 1 << bits
        counts = np.zeros((group.n, bins), np.int64)
        for part, scores, ids, known in group.scored() if group.n else ():
            base, n = group.base[part], part.stop - part.start
            at = counts[part]
            if shift + bits >= 64 or not base.any():  # the first round: all scores lie in the range
                place = (_places(scores, bound) >> np.uint64(shift)).astype(np.int64)
                query = np.broadcast_to(np.arange(n)[:, None], place.shape)
            else:
                query, row = _from(scores, base, bound)
                place = (_places(scores[query, row], bound) - base[query]) >> np.uint64(shift)
                query, place = query[place < bins], place[place < bins].astype(np.int64)
            inside = (place < bins).ravel()
            flat = (query * bins + place).ravel()
            at += np.bincount(flat if inside.all() else flat[inside], minlength=n * bins).reshape(n, bins)
            query, row = group.own(part, ids, known)
            place = (_places(scores[query, row], bound) - base[query]) >> np.uint64(shift)
            np.subtract.at(at, (query[place < bins], place[place < bins].astype(np.int64)), 1)
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts if group.n else counts
        query, place = np.nonzero((counts > 0) & (above < group.need[:, None])) if group.n else ([], [])
        return pa.table({
            "key": pa.array(group.keys[query] if group.n else [], pa.int64()),
            "bin": pa.array(place, pa.int64()),
            "n": pa.array(counts[query, place] if group.n else [], pa.int64()),
        })

    return run


def _taken(bound: int):
    """The last pass in a group: rows (key, query_id, vec_id, score) above the threshold, and of
    those equal to it the ``need`` smallest ids."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        group, found = _Group(queries, blocks), []
        for part, scores, ids, known in group.scored() if group.n else ():
            query, row = _from(scores, group.base[part], bound)
            score = scores[query, row].astype(np.int64)
            other = ~(known[row] & (ids[row] == group.ids[part][query]))
            found.append((query[other] + part.start, score[other], ids[row[other]], known[row[other]]))
        query, score, ids, known = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        known = known.astype(bool)
        if len(query):
            equal = _places(score, bound) == group.base[query]
            order = np.lexsort((ids, ~known, equal, query))
            query, score, ids, known, equal = (c[order] for c in (query, score, ids, known, equal))
            first = np.concatenate(([True], (query[1:] != query[:-1]) | (equal[1:] != equal[:-1])))
            nth = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            keep = ~equal | (nth < group.need[query])
            query, score, ids, known = (c[keep] for c in (query, score, ids, known))
        mine = (lambda c: c[query]) if group.n else (lambda _: [])
        return pa.table({
            "key": pa.array(mine(group.keys) if group.n else [], pa.int64()),
            "query_id": pa.array(mine(group.ids) if group.n else [], pa.int64()),
            "vec_id": pa.array(ids, pa.int64(), mask=~known),
            "score": pa.array(score, pa.int64()),
        })

    return run


class _Meeting:
    """Every query with every block of rows of its number of components, by bucket numbers."""

    def __init__(self, asked: DataFrame, held: DataFrame, query_buckets: int, row_buckets: int):
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        self.asked, self.each = asked.withColumn("qb", mine("key", query_buckets)), every(row_buckets)
        self.held = held.withColumn("rb", mine("block", row_buckets)).withColumn("qb", every(query_buckets))
        self.tasks = query_buckets * row_buckets

    def apply(self, state: DataFrame, run, schema: str) -> DataFrame:
        by = ["dim", "qb", "rb"]
        asked = self.asked.join(state, "key").withColumn("rb", self.each).select(*by, "key", "vec_id", "x", "base", "need")
        held = self.held.select(*by, "ids", "known", "kind", "x")
        # dealt out here, so that small inputs are not drawn together into few tasks
        tasks = min(self.tasks, 10 * int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        asked, held = (df.repartition(tasks, *by) for df in (asked, held))
        return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(run, schema)


def top_k(
    vectors: DataFrame,
    k: int = 20,
    is_query: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 64,
    block_rows: int = 1_024,
    bucket_bytes: int = 16_000_000,
    query_rows: int = 8_192,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest inner products, ties to the smaller id.

    Components become floor(``scale`` * x). Queries are the rows that ``is_query`` picks (by
    default ids divisible by 20); candidates are all rows but those with the query's own id.
    With fewer than ``k`` candidates all are returned, with none the query has no row.

    Vectors that are null or hold null or non-finite components take no part. Vectors meet only
    vectors of as many components; empty ones score 0. A row without an id is no query, but a
    candidate, after all others among equal scores. Repeated rows are candidates each; equal rows
    (id and vector) are one query, rows with one id and other vectors are queries of their own.
    Components and scores beyond 64 bits count as the nearest long. An empty table gives an
    empty result. Other columns are not read.

    Each query's range costs one round per ``ROUND_BITS`` bits. A round sends at most ``k`` counts
    per query and group of blocks. A query bucket holds about ``query_rows`` queries, a bucket of
    rows ``bucket_bytes``.
    """
    if k < 1:
        raise ValueError("k must be positive")
    source = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"), (is_query if is_query is not None else F.col(id_column) % 20 == 0).alias("ask"))
    rows = source.select("vec_id", whole_numbers(F.col("v"), scale).alias("x"), "ask").filter("x is not null")
    held = cut(packed(rows, block_rows, 1_000_000))
    asked = cut(rows.filter("ask and vec_id is not null").select("vec_id", "x").distinct())
    asked = asked.withColumn("key", F.monotonically_increasing_id()).withColumn("dim", F.size("x"))
    size = held.agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("x")).alias("bytes"), F.max("length").alias("length")).first()
    n_asked = asked.count()
    if not size.blocks or not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = int(min(size.length**2 * (1 + 1e-9) + 1, 2.0**63))  # no inner product is longer than both vectors
    bound = 2**63 if bound >= 2**52 else bound
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    row_buckets = min(size.blocks, max(-(-size.bytes // bucket_bytes), 4 * parallel))
    meeting = _Meeting(asked, held, -(-n_asked // query_rows), row_buckets)

    bits = min(64, (2 * bound).bit_length())
    state = asked.select("key", F.lit(0).cast("long").alias("base"), F.lit(k).cast("long").alias("need"))
    rounds = -(-bits // ROUND_BITS)
    for left in range(rounds, 0, -1):
        step = -(-bits // left)
        bits -= step
        counts = meeting.apply(state, _counts(bits, step, bound), "key long, bin long, n long")
        counts = counts.groupBy("key", "bin").agg(F.sum("n").alias("n"))
        by_key = Window.partitionBy("key")  # at most 2 ** ROUND_BITS rows
        higher = by_key.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("key", "bin", "n", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"), F.sum("n").over(by_key).alias("all"))
        here = state.join(counts, "key").withColumn("need", F.least("need", "all"))
        here = here.filter("above < need and need <= above + n")
        base = F.col("base").bitwiseOR(F.shiftleft("bin", bits))
        state = cut(here.select("key", base.alias("base"), (F.col("need") - F.col("above")).alias("need")))
    found = meeting.apply(state, _taken(bound), "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
