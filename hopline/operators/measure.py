"""Statistics over tables of timing samples, and comparisons between engines.

Samples are ``(engine, size, query, seq, value)`` rows; a series is one engine, size
and query. Summaries are ``(engine, size, query, min_ms, median_ms, p95_ms, max_ms,
iters)``. Comparisons work on summaries, whose groups are as small as the number
of engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopline.functions.text import round_stat
from hopline.plans.limits import DEFAULT_LIMITS, Limits
from hopline.plans.lineage import cut, settle
from hopline.plans.skew import first_rows

# What the reports are built on.
SERIES = ("engine", "size", "query")
P95 = 0.95
RATIO_FLAG = 100.0
RANKED_SIZES = ("small", "medium")
MESSAGE_CHARS = 120

#: Value ranges a hot series is split into.
RANGES = 1_000


def _positions(n: Column) -> dict[str, Column]:
    """1-based ranks of the order statistics: both middle ones, and p95."""
    return {
        "low": F.floor((n + 1) / 2),
        "high": F.floor(n / 2) + 1,
        "p95": F.floor(F.lit(P95) * n) + 1,
    }


def _ranks_in_task(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Order statistics when every series fits in one task."""
    series = Window.partitionBy(*by)
    counted = samples.select(
        *by,
        F.col(value).alias("v"),
        F.row_number().over(series.orderBy(value)).alias("rank"),
        F.count("*").over(series).alias("n"),
    )
    picks = [
        F.max(F.when(F.col("rank") == position, F.col("v"))).alias(name)
        for name, position in _positions(F.col("n")).items()
    ]
    return counted.groupBy(*by).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("n"), *picks
    )


def _ranks_by_range(
    samples: DataFrame, by: Sequence[str], value: str, limits: Limits
) -> DataFrame:
    """Order statistics of series of any size, exactly.

    Value ranges are counted per series, which tells the one range that holds each
    wanted rank. Only the values in those ranges are looked at again, counted per
    distinct value, so neither a hot series nor a hot value ends up in one task.
    """
    cuts = samples.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    # Not-a-number sorts behind all else, as in a sort; the extra range holds it.
    ranged = Bucketizer(
        splits=edges, inputCol="v", outputCol="range", handleInvalid="keep"
    ).transform(samples.select(F.struct(*by).alias("series"), F.col(value).cast("double").alias("v")))
    by_names, by = list(by), ["series"]  # a struct of nulls equals itself in a join
    tallies = cut(
        ranged.groupBy(*by, "range").agg(
            F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
    )
    series = Window.partitionBy(*by)
    running = series.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = tallies.select(
        *by,
        "range",
        "c",
        F.coalesce(F.sum("c").over(running), F.lit(0)).alias("below"),
        F.sum("c").over(series).alias("n"),
    )
    wanted = placed.select(
        *by,
        "range",
        "below",
        "c",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("stat"), position.alias("rank"))
                    for name, position in _positions(F.col("n")).items()
                ]
            )
        ),
    ).where((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("c")))
    wanted = wanted.drop("c")
    keys = [*by, "range"]
    in_range = settle(wanted.select(*keys).distinct(), limits)
    if in_range.rows <= limits.broadcast_rows:
        values = ranged.join(F.broadcast(in_range.df), keys, "left_semi")
        values = values.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    else:
        values = ranged.groupBy(*keys, "v").agg(F.count("*").alias("c"))
        values = values.join(in_range.df, keys, "left_semi")
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    picked = (
        values.withColumn("upto", upto)
        .join(wanted, keys)
        .where(
            (F.col("rank") <= F.col("below") + F.col("upto"))
            & (F.col("rank") > F.col("below") + F.col("upto") - F.col("c"))
        )
    )
    stats = picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("stat") == s, F.col("v"))).alias(s) for s in ("low", "high", "p95")]
    )
    extremes = tallies.groupBy(*by).agg(
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("c").alias("n")
    )
    return extremes.join(stats, "series").select(
        *[F.col(f"series.{c}").alias(c) for c in by_names], "min", "max", "n", "low", "high", "p95"
    )


def summarise(
    samples: DataFrame,
    by: Sequence[str] = SERIES,
    value: str = "value",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``by, min_ms, median_ms, p95_ms, max_ms, iters`` of every series.

    p95 is the sample at 0-based position ``floor(0.95 n)`` of the sorted series;
    the median of an even number of samples is the mean of the middle two.
    """
    measured = samples.where(F.col(value).isNotNull())
    largest = measured.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= limits.group_rows:
        ranks = _ranks_in_task(measured, by, value)
    else:
        ranks = _ranks_by_range(measured, by, value, limits)
    return ranks.select(
        *by,
        round_stat(F.col("min")).alias("min_ms"),
        round_stat((F.col("low") + F.col("high")) / 2).alias("median_ms"),
        round_stat(F.col("p95")).alias("p95_ms"),
        round_stat(F.col("max")).alias("max_ms"),
        F.col("n").cast("long").alias("iters"),
    )


def without_warmup(
    samples: DataFrame,
    warmup: int,
    by: Sequence[str] = SERIES,
    sequence: str = "seq",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Samples without the first ``warmup`` of each series by ``sequence``.

    ``sequence`` must be unique within a series. Each task proposes only its own
    first samples, so a long series is never sorted in one place.
    """
    # Keys as one struct: a series with a null in its key equals itself.
    key = F.struct(*by, sequence).alias("_key")
    first = first_rows(samples.select(*by, sequence), by, [sequence], warmup)
    dropped = settle(first.select(key), limits)
    small = dropped.rows <= limits.broadcast_rows
    marked = samples.withColumn("_key", key)
    return marked.join(
        F.broadcast(dropped.df) if small else dropped.df, "_key", "left_anti"
    ).drop("_key")


def engine_ratios(
    summary: DataFrame, stat: str = "median_ms", threshold: float = RATIO_FLAG
) -> DataFrame:
    """Slowest over fastest engine for every size and query that two engines ran.

    ``(size, query, slowest, fastest, slowest_ms, fastest_ms, ratio, flagged)``; a
    ratio over a non-positive minimum is 0. Ties go to the engine first by name.
    """
    ms = F.col(stat)
    grouped = (
        summary.where(ms.isNotNull())
        .groupBy("size", "query")
        .agg(
            F.min(F.struct((-ms).alias("key"), "engine")).alias("top"),
            F.min(F.struct(ms.alias("key"), "engine")).alias("bottom"),
            F.count("*").alias("engines"),
        )
        .where(F.col("engines") >= 2)
    )
    slow, fast = -F.col("top.key"), F.col("bottom.key")
    ratio = F.when(fast > 0, slow / F.when(fast > 0, fast)).otherwise(0.0)
    return grouped.select(
        "size",
        "query",
        F.col("top.engine").alias("slowest"),
        F.col("bottom.engine").alias("fastest"),
        slow.alias("slowest_ms"),
        fast.alias("fastest_ms"),
        ratio.alias("ratio"),
        (ratio > threshold).alias("flagged"),
    )


def anomalies(
    summary: DataFrame, stat: str = "median_ms", threshold: float = RATIO_FLAG
) -> DataFrame:
    """The flagged rows of :func:`engine_ratios`."""
    return engine_ratios(summary, stat, threshold).where("flagged").drop("flagged")


def against_others(
    summary: DataFrame, stat: str = "median_ms", threshold: float = RATIO_FLAG
) -> DataFrame:
    """Each engine against the fastest and slowest of the others, per size and query.

    ``(engine, size, query, slower_by, faster_by, verdict)``; the verdict is
    ``slower``, ``faster`` or null, and an engine at zero gets none. The others'
    extremes come from the rows before and after in order, not from pairs.
    """
    order = Window.partitionBy("size", "query").orderBy(stat, "engine")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    ms = F.col(stat)
    others = summary.where(ms.isNotNull()).select(
        "engine",
        "size",
        "query",
        ms.alias("own"),
        F.least(F.min(ms).over(before), F.min(ms).over(after)).alias("least"),
        F.greatest(F.max(ms).over(before), F.max(ms).over(after)).alias("most"),
    )
    own, least, most = F.col("own"), F.col("least"), F.col("most")
    judged = others.where(least.isNotNull() & (own != 0)).select(
        "engine",
        "size",
        "query",
        F.when(least > 0, own / F.when(least > 0, least)).otherwise(0.0).alias("slower_by"),
        F.when(own > 0, most / F.when(own > 0, own)).otherwise(0.0).alias("faster_by"),
    )
    verdict = F.when(F.col("slower_by") > threshold, "slower").when(
        F.col("faster_by") > threshold, "faster"
    )
    return judged.withColumn("verdict", verdict)


def rank_engines(summary: DataFrame, sizes: Sequence[str] = RANKED_SIZES) -> DataFrame:
    """``(place, engine, avg_ms, pairs)``: engines by the mean of their medians.

    Rows without a median (errors) do not count. One row per engine is ranked.
    """
    usable = summary.where(F.col("size").isin(list(sizes)) & F.col("median_ms").isNotNull())
    if "error" in summary.columns:
        usable = usable.where(F.col("error").isNull())
    means = usable.groupBy("engine").agg(
        F.avg("median_ms").alias("avg_ms"), F.count("*").alias("pairs")
    )
    place = F.row_number().over(Window.orderBy("avg_ms", "engine"))
    return means.select(place.cast("long").alias("place"), "engine", "avg_ms", "pairs")


def comparison_table(
    summary: DataFrame, engines: Sequence[str], stat: str = "median_ms"
) -> DataFrame:
    """``size, query`` and one column per engine holding its statistic."""
    return summary.groupBy("size", "query").pivot("engine", list(engines)).agg(F.first(stat))


def load_table(
    records: DataFrame,
    engines: Sequence[str],
    ms: str = "ingest_ms",
    skipped: str = "skipped",
) -> DataFrame:
    """``size`` and one text column per engine: its milliseconds, ``skipped``, or a dash."""
    cell = F.when(F.col(skipped), F.lit("skipped")).otherwise(F.col(ms).cast("string"))
    table = (
        records.withColumn("cell", cell)
        .groupBy("size")
        .pivot("engine", list(engines))
        .agg(F.first("cell", ignorenulls=True))
    )
    return table.select("size", *[F.coalesce(e, F.lit("—")).alias(e) for e in engines])


def error_list(errors: DataFrame, chars: int = MESSAGE_CHARS) -> DataFrame:
    """``(engine, size, query, message)`` with messages cut to ``chars`` characters."""
    return errors.select(
        "engine", "size", "query", F.substring("message", 1, chars).alias("message")
    )
