"""Reading, materialising and upserting node, edge and vector tables."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.model import (
    EDGE_SCHEMA,
    NODE_SCHEMA,
    VECTOR_NODE_SCHEMA,
    Layout,
    PropertyGraph,
    conform,
)
from hopline.plans.limits import DEFAULT_LIMITS, Limits
from hopline.plans.skew import in_list


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Scan a Parquet node table, cast to the node contract."""
    return conform(spark.read.parquet(path), NODE_SCHEMA)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Scan a Parquet edge table, every row kept, cast to the edge contract."""
    return conform(spark.read.parquet(path), EDGE_SCHEMA)


def read_vector_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Scan a Parquet node table with an embedding column."""
    return conform(spark.read.parquet(path), VECTOR_NODE_SCHEMA)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Scan only the named columns."""
    return spark.read.parquet(path).select(*columns)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a Parquet table in place of any earlier one and read it back.

    No shuffle: every task writes what it holds, so one heavy key cannot slow it.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialise_clustered(
    df: DataFrame, path: str, order: Sequence[str], files: int | None = None
) -> DataFrame:
    """:func:`materialise`, range-partitioned and sorted by ``order``.

    A filter or an ``IN`` list on the leading column then skips all row groups but
    a few. Name further columns after it: a heavy key is then split over files by
    them, where bucketing would give it one task. Identical rows are told apart by
    the partition they come from, so many copies of one row are split as well.
    """
    columns = [F.col(c) for c in order]
    marked = df.withColumn("_from", F.spark_partition_id())
    keys = [*columns, F.col("_from")]
    spread = marked.repartitionByRange(files, *keys) if files else marked.repartitionByRange(*keys)
    return materialise(spread.sortWithinPartitions(*columns).drop("_from"), path)


def materialise_by_period(df: DataFrame, path: str, period_ms: int, ts: str = "ts") -> DataFrame:
    """:func:`materialise`, one folder per stretch of ``period_ms`` milliseconds.

    A crowded period is split over writing tasks.
    """
    period = F.floor(F.col(ts) / period_ms).cast("long")
    by_period = df.withColumn("period", period).hint("rebalance", "period")
    by_period.write.mode("overwrite").partitionBy("period").parquet(path)
    return df.sparkSession.read.parquet(path)


def _curve(share: int, nth: int, columns: int, bits: int, finer: int) -> int:
    """What the number of a row's share in the ``nth`` column adds to its place on the curve.

    The bits of all columns' stretches, taken in turn, then the numbers of narrower ones in
    turn: rows near in all columns stay near.
    """
    coarse = share >> finer
    place = sum((coarse >> bit & 1) << (bit * columns + nth) for bit in range(bits + 1))
    return (place << finer * columns) + (share % 2**finer << finer * (columns - 1 - nth))


#: Sort keys tell stretches apart that are narrower than those of the curve, ``2 ** FINER`` in each.
FINER = 4


def _shares(df: DataFrame, columns: Sequence[str], parts: int) -> list[list[float]]:
    """The values that part the rows of each column into ``parts`` about equal shares; none without values.

    Every row goes into a sketch per column, all in one scan. A bound is off by about three shares.
    """
    given = [F.col(c).cast("double") for c in columns]
    values = [F.when(~F.isnan(x), x) for x in given]
    size = F.lit(min(2 * parts, 65_535))
    kept = [F.struct(F.count(x).alias("n"), F.kll_sketch_agg_double(x, size).alias("sketch")) for x in values]
    share = F.expr(f"array({', '.join(f'{i / parts}D' for i in range(1, parts))})")
    found = [
        F.when(F.col(f"_{i}.n") > 0, F.kll_sketch_get_quantile_double(F.col(f"_{i}.sketch"), share)).alias(f"_{i}")
        for i in range(len(columns))
    ]
    row = df.agg(*[k.alias(f"_{i}") for i, k in enumerate(kept)]).select(*found).first()
    return [list(bounds or []) for bounds in row]


def _placed(df: DataFrame, column: str, bounds: Sequence[float], name: str, places: Sequence[int]) -> DataFrame:
    """``df`` with the place ``name``, out of ``places``, of the share that a row's ``column`` lies in.

    A value that fills several shares counts for the last of them. Nulls and NaN come last.
    """
    finite = sorted(x for x in bounds if abs(x) < float("inf"))
    inner = sorted(set(finite)) or [0.0]
    splits = [-float("inf"), *inner, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="_as_double", outputCol=name, handleInvalid="keep")
    numbered = cutter.transform(df.withColumn("_as_double", F.col(column).cast("double"))).drop("_as_double")
    shares = [0, *[bisect_right(finite, x) for x in inner]]
    found = f"get(array({', '.join(f'{places[n]}L' for n in shares)}), int(`{name}`))"
    return numbered.withColumn(name, F.expr(f"coalesce({found}, {places[-1]}L)"))


def materialise_by_curve(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = ("src", "ts"),
    files: int | None = None,
    bits: int = 8,
    row_group_bytes: int = 16_000_000,
) -> DataFrame:
    """:func:`materialise`, in the order of a curve through ``columns``, so that one layout skips by each.

    Every column is cut into at most ``2 ** bits`` stretches of about equally many rows (their
    bounds reach the driver); the stretches' numbers, bit by bit in turn, give the order. A file
    or row group then spans a narrow range of all columns at once, and a hop from a few sources
    within a time window reads those that meet both. A source with very many edges is cut by
    the other columns. Nulls go with the last stretch.

    The numbers of narrower stretches follow in the same long, so that a sort by it seldom
    has to compare the columns themselves.
    """
    n = len(columns)
    bits = min(bits, 63 // n - 1)  # a long has no more
    finer = min(FINER, 63 // n - bits - 1)
    parts = 2 ** (bits + finer)
    placed = df
    for i, (column, bounds) in enumerate(zip(columns, _shares(df, columns, parts))):
        places = [_curve(share, i, n, bits, finer) for share in range(parts + 1)]
        placed = _placed(placed, column, bounds, f"_{column}", places)
    place = sum((F.col(f"_{c}") for c in columns[1:]), F.col(f"_{columns[0]}"))
    placed = placed.select(*df.columns, place.alias("_place"))
    # identical rows are told apart by the partition they come from, so that copies are split too
    keys = ["_place", *columns, "_from"]
    marked = placed.withColumn("_from", F.spark_partition_id())
    spread = marked.repartitionByRange(files, *keys) if files else marked.repartitionByRange(*keys)
    ordered = spread.sortWithinPartitions("_place", *columns).drop("_place", "_from")
    ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_window(
    spark: SparkSession, path: str, period_ms: int, ts_lo: int, ts_hi: int
) -> DataFrame:
    """Edges of a closed time window; folders of other periods are not opened."""
    stored = spark.read.parquet(path)
    periods = F.col("period").between(ts_lo // period_ms, ts_hi // period_ms)
    inside = F.col("ts").between(ts_lo, ts_hi)
    return conform(stored.where(periods & inside), EDGE_SCHEMA)


def split_edges(graph: PropertyGraph, path: str, name: str, buckets: int) -> PropertyGraph:
    """Store the edges of ordinary sources bucketed by source, and those of hubs apart.

    Hops from a large frontier then read the bucketed part in place, without
    shuffling it. Hubs would overload a bucket; their edges are range-partitioned
    by target instead. ``name`` becomes a table of the session's catalogue.
    """
    spark = graph.nodes.sparkSession
    cold, hot = replace(graph, parts=None).cold_and_hot()
    (
        cold.repartition(buckets, "src")
        .write.mode("overwrite")
        .option("path", f"{path}/cold")
        .bucketBy(buckets, "src")
        .sortBy("src")
        .saveAsTable(name)
    )
    parts = (
        spark.table(name),
        materialise_clustered(hot, f"{path}/hot", hot.columns),
    )
    return replace(graph, edges=parts[0].unionByName(parts[1]), parts=parts)


def store_graph(graph: PropertyGraph, path: str, buckets: int = 61) -> PropertyGraph:
    """Store nodes, and edges twice: in buckets by source and in buckets by target.

    A hop from a few nodes, forwards or over ``reversed()``, reads the folders of their
    buckets only. A crowded bucket is split over files; within them edges are sorted by the
    key. Buckets are ids modulo ``buckets``, a prime, which spreads ids that rise in steps.
    The manifest is written last; without it there is no graph at ``path``.
    """
    spark = graph.nodes.sparkSession
    _delete(spark, f"{path}/{MANIFEST}")
    materialise_clustered(graph.nodes, f"{path}/nodes", ["id"])
    for key, other in (("src", "dst"), ("dst", "src")):
        bucket = F.pmod(F.col(key), F.lit(buckets)).cast("int")
        dealt = graph.edges.withColumn("bucket", bucket).hint("rebalance", "bucket")
        dealt = dealt.sortWithinPartitions("bucket", key, other)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/by_{key}")
    manifest = json.dumps({"buckets": buckets, "endpoints_ok": graph.endpoints_ok})
    kept = spark.createDataFrame([(manifest,)], "value string")
    kept.coalesce(1).write.mode("overwrite").text(f"{path}/{MANIFEST}")
    return open_graph(spark, path, graph.limits)


def open_graph(spark: SparkSession, path: str, limits: Limits = DEFAULT_LIMITS) -> PropertyGraph:
    """A graph that :func:`store_graph` has written, with both its layouts."""
    manifest = json.loads(spark.read.text(f"{path}/{MANIFEST}").first()[0])
    layouts = {
        key: Layout(spark.read.parquet(f"{path}/by_{key}"), manifest["buckets"]) for key in ("src", "dst")
    }
    return PropertyGraph(
        read_nodes(spark, f"{path}/nodes"),
        conform(layouts["src"].df, EDGE_SCHEMA),
        endpoints_ok=manifest["endpoints_ok"],
        limits=limits,
        layouts=layouts,
    )


def append(df: DataFrame, path: str) -> None:
    """Add a batch of rows to a Parquet table; the partitions are the chunks.

    A batch that is delivered twice leaves duplicates here, which
    :func:`latest_per_key` removes on reading.
    """
    df.write.mode("append").parquet(path)


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    sequence: str,
    columns: Sequence[str] | None = None,
    combine: bool = False,
) -> DataFrame:
    """Keyed upsert: one row per key, the one with the highest ``sequence``.

    Rows with equal sequence are told apart by the other columns. Rows are counted by
    stretches of key hashes first: keys with very many versions are combined on the map
    side and send one row per task (with ``combine`` all are), the others are dealt out once, a
    million rows to a task, and combined there, so that no hash table grows with the table.
    """
    kept = {*keys, sequence, *(columns or df.columns)}
    rows = df.select(*[c for c in df.columns if c in kept])
    task = []
    if not combine:
        counted, stretch = _stretches(rows, keys, 1)
        tasks = max(1, -(-sum(r["count"] for r in counted) // TASK_ROWS))
        rows = _crowds_combined(rows, counted, stretch, keys, sequence)
        task = ["_task"]
        rows = rows.withColumn("_task", F.floor(stretch * tasks / STRETCHES).cast("int")).repartitionById(tasks, *task)
    rest = [c for c in rows.columns if c not in (*keys, sequence, *task)]
    if not rest:
        latest = rows.groupBy(*keys, *task).agg(F.max(sequence).alias(sequence))
    else:
        newest = F.max(F.struct(sequence, *rest)).alias("_newest")
        latest = rows.groupBy(*keys, *task).agg(newest).select(*keys, "_newest.*")
    return latest.select(*[c for c in rows.columns if c not in task])


#: Folder, beside a table's data, of what says which data count.
MANIFEST = "_manifest"


def _place(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def _stored_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a stored keyed table, in order."""
    root, files = _place(spark, f"{path}/{MANIFEST}")
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    done = [int(n[8:]) for n in names if n.startswith("version=")]
    finished = [_place(spark, f"{path}/{MANIFEST}/version={n}/_SUCCESS")[0] for n in done]
    return sorted(n for n, mark in zip(done, finished) if files.exists(mark))


def _manifest(spark: SparkSession, path: str, version: int) -> tuple[int, dict[int, int]]:
    """Number of buckets, and the version in which each bucket was written last."""
    rows = spark.read.parquet(f"{path}/{MANIFEST}/version={version}").collect()  # a row per bucket
    return rows[0].buckets, {r.bucket: r.written for r in rows if r.written is not None}


def _folder(path: str, version: int, bucket: int) -> str:
    return f"{path}/version={version}/bucket={bucket}"


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of a table that :func:`upsert` keeps."""
    version = _stored_versions(spark, path)[-1]
    written = _manifest(spark, path, version)[1]
    schema = spark.read.parquet(f"{path}/_schema").schema
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_folder(path, v, b) for b, v in sorted(written.items())])


#: Stretches of key hashes whose rows are counted before a batch is dealt out, and rows that one task gets.
STRETCHES, TASK_ROWS = 4_096, 1_000_000


def _stretches(rows: DataFrame, keys: Sequence[str], buckets: int):
    """Rows ``(stretch, count)`` per stretch of key hashes, and the column that tells a row's stretch."""
    stretch = F.pmod(F.xxhash64(*keys), F.lit(buckets * max(1, STRETCHES // buckets)))
    return rows.groupBy(stretch.alias("stretch")).count().collect(), stretch


def _crowds_combined(rows: DataFrame, counted: list, stretch, keys: Sequence[str], sequence: str) -> DataFrame:
    """Keys with very many versions, and what shares their stretch, are combined where they are."""
    most = max(TASK_ROWS, 8 * sum(r["count"] for r in counted) // STRETCHES)
    crowded = [r.stretch for r in counted if r["count"] > most]
    if not crowded:
        return rows
    apart = in_list("_stretch", crowded)
    marked = rows.withColumn("_stretch", stretch)
    many = marked.where(apart).drop("_stretch")
    return marked.where(~apart).drop("_stretch").unionByName(latest_per_key(many, keys, sequence, None, True))


def _by_bucket(rows: DataFrame, keys: Sequence[str], sequence: str, buckets: int, tasks: int) -> DataFrame:
    """The latest row per key with its ``bucket``, in the order of keys within a task.

    One shuffle deals the rows out by bucket and key hash, one sort in a task puts the versions
    of a key together. Few keys repeat in a batch, so nothing is combined before.
    """
    each = max(1, STRETCHES // buckets)
    stretch = F.pmod(F.xxhash64(*keys), F.lit(buckets * each))
    place = (stretch % buckets) * each + F.floor(stretch / buckets)
    dealt = rows.withColumn("bucket", (stretch % buckets).cast("int"))
    dealt = dealt.withColumn("_task", F.floor(place * tasks / (buckets * each)).cast("int"))
    dealt = dealt.repartitionById(tasks, "_task")
    rest = [c for c in rows.columns if c not in keys and c != sequence]
    versions = Window.partitionBy(*keys, "bucket", "_task").orderBy(*[F.col(c).desc() for c in (sequence, *rest)])
    nth = F.row_number().over(versions)
    return dealt.withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_nth", "_task")


def upsert(
    batch: DataFrame, path: str, keys: Sequence[str], sequence: str, buckets: int = 64
) -> DataFrame:
    """Put a batch into a stored table with one row per key, and return the table.

    Rows are kept in ``buckets`` by a hash of their key (set by the first batch). Only the
    buckets that the batch has keys of are read and written again, in a folder of the new
    version; the others stay where they are. A manifest says which version of each bucket
    counts and is written last, so a job that fails leaves the old table, readers of it are
    not disturbed, and a batch that is delivered twice changes nothing. The version before
    the last is kept, what only earlier ones use is removed. One writer at a time.
    """
    spark = batch.sparkSession
    versions = _stored_versions(spark, path)
    written: dict[int, int] = {}
    if versions:
        buckets, written = _manifest(spark, path, versions[-1])
    else:
        batch.limit(0).write.mode("overwrite").parquet(f"{path}/_schema")
    number = versions[-1] + 1 if versions else 1
    counted, stretch = _stretches(batch, keys, buckets)
    touched = sorted({r.stretch % buckets for r in counted})
    stored = [_folder(path, written[b], b) for b in touched if b in written]
    given = sum(r["count"] for r in counted)
    rows, total = _crowds_combined(batch, counted, stretch, keys, sequence), given
    if stored:
        held = spark.read.schema(batch.schema).parquet(*stored)
        rows, total = held.unionByName(rows), total + held.count()
    if touched:
        tasks = -(-total * buckets // (TASK_ROWS * len(touched)))
        newest = _by_bucket(rows, keys, sequence, buckets, tasks)
        newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")
    now = {**written, **dict.fromkeys(touched, number)}
    manifest = [(buckets, b, v) for b, v in sorted(now.items())] or [(buckets, None, None)]
    kept = spark.createDataFrame(manifest, "buckets int, bucket int, written int")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}/version={number}")
    if len(versions) > 1:  # what the version before the last still used, and this one and the last do not
        for b, v in _manifest(spark, path, versions[-2])[1].items():
            if v not in (now.get(b), written.get(b)):
                _delete(spark, _folder(path, v, b))
        _delete(spark, f"{path}/{MANIFEST}/version={versions[-2]}")
    return read_stored(spark, path)


def array_shape(df: DataFrame, column: str, dim: int, element: T.DataType | None = None) -> DataFrame:
    """``column`` cast to an array of ``element``; a vector of another length fails the job."""
    element = element or T.FloatType()
    length = F.size(column)
    message = F.concat(F.lit(f"{column}: expected {dim} elements, found "), length.cast("string"))
    wrong = F.raise_error(message).cast(T.ArrayType(element))
    fitted = F.when(length == dim, F.col(column).cast(T.ArrayType(element))).otherwise(wrong)
    return df.withColumn(column, fitted)
