import random
import statistics

import pytest
from pyspark.sql import functions as F

from graphs import TINY
from hopline.functions.text import stem_engine, stem_size
from hopline.operators import measure
from hopline.plans.limits import Limits

FIELDS = "engine string, size string, query string, seq long, value double"


def series():
    rng = random.Random(3)
    out = []
    for n, query in [(1, "one"), (2, "two"), (19, "nineteen"), (20, "twenty"), (501, "many")]:
        out += [("e", "small", query, i, round(rng.expovariate(0.1), 2)) for i in range(n)]
    # A hot series, most of it one value.
    out += [("e", "small", "hot", i, 5.0 if i % 4 else float(i % 97)) for i in range(2_000)]
    return out


def expected(rows):
    by = {}
    for *_, query, _, value in rows:
        by.setdefault(query, []).append(value)
    return {
        q: (min(v), statistics.median(v), sorted(v)[int(0.95 * len(v))], max(v), len(v))
        for q, v in by.items()
    }


@pytest.mark.parametrize("limits", [Limits(), TINY, Limits(group_rows=3)])
def test_summary(spark, limits):
    rows = series()
    got = measure.summarise(spark.createDataFrame(rows, FIELDS), limits=limits).collect()
    stats = {r.query: (r.min_ms, r.median_ms, r.p95_ms, r.max_ms, r.iters) for r in got}
    want = expected(rows)
    assert stats.keys() == want.keys()
    for query, values in want.items():
        assert stats[query] == pytest.approx(values, abs=1e-4)


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_warmup(spark, limits):
    df = spark.createDataFrame(series(), FIELDS)
    kept = measure.without_warmup(df, 3, limits=limits).groupBy("query").agg(
        F.count("*").alias("n"), F.min("seq").alias("first")
    )
    got = {r["query"]: (r.n, r["first"]) for r in kept.collect()}
    assert got == {"nineteen": (16, 3), "twenty": (17, 3), "many": (498, 3), "hot": (1997, 3)}


def medians(spark, rows):
    return spark.createDataFrame(rows, "engine string, size string, query string, median_ms double")


def test_ratios_and_flags(spark):
    df = medians(
        spark,
        [
            ("a", "small", "far", 1.0), ("b", "small", "far", 100.5), ("c", "small", "far", 2.0),
            ("a", "small", "edge", 1.0), ("b", "small", "edge", 100.0),
            ("a", "small", "zero", 0.0), ("b", "small", "zero", 5.0),
            ("a", "small", "alone", 3.0), ("b", "small", "alone", None),
        ],
    )
    got = {r.query: r for r in measure.engine_ratios(df).collect()}
    assert set(got) == {"far", "edge", "zero"}
    assert (got["far"].slowest, got["far"].fastest, got["far"].flagged) == ("b", "a", True)
    assert got["edge"].ratio == 100.0 and not got["edge"].flagged
    assert got["zero"].ratio == 0.0
    assert [r.query for r in measure.anomalies(df).collect()] == ["far"]


def test_one_engine_against_the_others(spark):
    df = medians(
        spark,
        [
            ("a", "s", "q", 1.0), ("b", "s", "q", 150.0), ("c", "s", "q", 10.0),
            ("a", "s", "z", 0.0), ("b", "s", "z", 7.0), ("a", "s", "lone", 1.0),
        ],
    )
    got = {(r.engine, r.query): r for r in measure.against_others(df).collect()}
    assert set(got) == {("a", "q"), ("b", "q"), ("c", "q"), ("b", "z")}
    assert got["b", "q"].verdict == "slower" and got["b", "q"].slower_by == 150.0
    assert got["a", "q"].verdict == "faster" and got["a", "q"].faster_by == 150.0
    assert got["c", "q"].verdict is None
    assert got["b", "z"].slower_by == 0.0 and got["b", "z"].faster_by == 0.0


def test_ranking_skips_errors_and_other_sizes(spark):
    df = medians(
        spark,
        [
            ("a", "small", "q", 4.0), ("a", "medium", "q", 2.0), ("a", "large", "q", 900.0),
            ("b", "small", "q", 1.0), ("b", "small", "bad", None), ("c", "large", "q", 0.1),
        ],
    )
    got = [tuple(r) for r in measure.rank_engines(df).orderBy("place").collect()]
    assert got == [(1, "b", 1.0, 1), (2, "a", 3.0, 2)]


def test_tables(spark):
    df = medians(spark, [("a", "small", "q", 4.0), ("b", "small", "q", 2.0), ("a", "small", "r", 1.0)])
    got = {r.query: (r.a, r.b) for r in measure.comparison_table(df, ["a", "b"]).collect()}
    assert got == {"q": (4.0, 2.0), "r": (1.0, None)}
    loads = spark.createDataFrame(
        [("a", "small", 66.59, False), ("b", "small", None, True), ("a", "large", None, False)],
        "engine string, size string, ingest_ms double, skipped boolean",
    )
    got = {r["size"]: (r.a, r.b) for r in measure.load_table(loads, ["a", "b"]).collect()}
    assert got == {"small": ("66.59", "skipped"), "large": ("—", "—")}


def test_error_messages_are_cut(spark):
    errors = spark.createDataFrame(
        [("a", "small", "q", "x" * 200)], "engine string, size string, query string, message string"
    )
    assert measure.error_list(errors).first().message == "x" * 120


def test_stem_splits_at_the_last_underscore(spark):
    df = spark.createDataFrame([("vec_a_small",), ("b_large",), ("plain",)], "stem string")
    got = [
        (r.e, r.s)
        for r in df.select(stem_engine(F.col("stem")).alias("e"), stem_size(F.col("stem")).alias("s")).collect()
    ]
    assert got == [("vec_a", "small"), ("b", "large"), ("", "")]


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_null_keys_and_not_a_number(spark, limits):
    rows = [(None, "s", "q", i, float(i)) for i in range(9)]
    rows += [("e", None, "q", i, float("nan") if i == 4 else float(i)) for i in range(5)]
    got = measure.summarise(spark.createDataFrame(rows, FIELDS), limits=limits).collect()
    stats = {(r.engine, r["size"]): r for r in got}
    assert set(stats) == {(None, "s"), ("e", None)}
    assert (stats[None, "s"].median_ms, stats[None, "s"].iters) == (4.0, 9)
    assert stats["e", None].median_ms == 2.0 and stats["e", None].iters == 5
    assert stats["e", None].max_ms != stats["e", None].max_ms  # not a number sorts last


@pytest.mark.parametrize("warmup", [3, 1001])
def test_warmup_of_a_series_without_engine(spark, warmup):
    rows = [(None, "s", "q", i, 1.0) for i in range(1500)] + [("e", "s", "q", i, 1.0) for i in range(4)]
    left = measure.without_warmup(spark.createDataFrame(rows, FIELDS).repartition(5), warmup)
    want = sorted((str(e), i) for e, _, _, i, _ in rows if i >= warmup)
    assert sorted((str(r.engine), r.seq) for r in left.collect()) == want
