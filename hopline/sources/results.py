"""Result documents: one nested JSON document per engine and size.

``{"db", "size", "ingest": {"ingest_ms"}, "index_build": {"build_ms"},
"queries": {name: {"min_ms", "median_ms", "p95_ms", "max_ms", "iters"} or
{"error"}, "_errors": {name: text}}}``, or ``{"db", "size", "skipped", "reason"}``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.functions.text import stem_engine, stem_size

# The documents' field names.
STAT_FIELDS = "min_ms double, median_ms double, p95_ms double, max_ms double, iters long"
QUERY_FIELDS = f"{STAT_FIELDS}, error string"
DOCUMENT_FIELDS = (
    "db string, size string, skipped boolean, reason string, "
    "ingest string, index_build string, queries string"
)
ERRORS_KEY = "_errors"


def write_results(summary: DataFrame, path: str, skipped: DataFrame | None = None) -> None:
    """Write ``(engine, size, query, min_ms, …, iters)`` as one document per engine and size.

    Each document is a row, found under ``stem=<engine>_<size>/``. The rows gathered
    into a document are the query names of one engine and size, not the samples. With an
    ``error`` column, a query that has one is written with it and without its missing
    statistics. ``skipped`` rows ``(engine, size, reason)`` become documents of their own.
    """
    stats = [c.strip().split(" ")[0] for c in STAT_FIELDS.split(",")]
    stats += ["error"] if "error" in summary.columns else []
    entry = F.struct(F.col("query").alias("key"), F.struct(*stats).alias("value"))
    documents = summary.groupBy("engine", "size").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("queries")
    )
    if skipped is not None:
        reasons = skipped.select("engine", "size", F.lit(True).alias("skipped"), "reason")
        documents = documents.unionByName(reasons, allowMissingColumns=True)
    rest = [c for c in documents.columns if c not in ("engine", "size")]
    (
        documents.select(
            F.concat_ws("_", _escaped("engine"), _escaped("size")).alias("stem"),
            F.col("engine").alias("db"),
            "size",
            *rest,
        )
        .write.mode("overwrite")
        .partitionBy("stem")
        .json(path)
    )


def _escaped(name: str) -> Column:
    """A name without underscores, written so that two stems never meet."""
    return F.replace(F.url_encode(F.col(name)), F.lit("_"), F.lit("%5F"))


def _stem(path: Column) -> Column:
    """The document's key: its ``stem=`` folder if it has one, else its file name."""
    folder = F.regexp_extract(path, r"/stem=([^/]+)/", 1)
    file = F.regexp_extract(path, r"([^/]+)\.json$", 1)
    return F.when(folder != "", folder).otherwise(file)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON document below ``path``, keyed by its own ``db`` and ``size``, else by file name.

    Files whose name has no underscore are not result files and are left out.
    """
    raw = (
        spark.read.schema(DOCUMENT_FIELDS)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
        .withColumn("stem", _stem(F.input_file_name()))
    )
    keyed = raw.select(
        stem_engine(F.col("stem")).alias("stem_engine"), stem_size(F.col("stem")).alias("stem_size"), "*"
    )
    return keyed.where(F.col("stem_engine") != "").select(
        F.coalesce("db", "stem_engine").alias("engine"),
        F.coalesce("size", "stem_size").alias("size"),
        "db",
        F.coalesce("skipped", F.lit(False)).alias("skipped"),
        "reason",
        F.get_json_object("ingest", "$.ingest_ms").cast("double").alias("ingest_ms"),
        F.coalesce(F.get_json_object("ingest", "$.skipped").cast("boolean"), F.lit(False)).alias(
            "ingest_skipped"
        ),
        F.get_json_object("index_build", "$.build_ms").cast("double").alias("build_ms"),
        F.from_json("queries", "map<string,string>").alias("queries"),
    )


def query_stats(documents: DataFrame) -> DataFrame:
    """One row per engine, size and query, with its statistics or its error."""
    exploded = documents.select("engine", "size", F.explode("queries").alias("query", "body"))
    parsed = exploded.where(F.col("query") != ERRORS_KEY).withColumn(
        "stats", F.from_json("body", QUERY_FIELDS)
    )
    return parsed.select("engine", "size", "query", "stats.*")


def error_messages(documents: DataFrame) -> DataFrame:
    """One row per query with an error: ``engine, size, query, message``.

    The message is the one recorded under ``_errors``, else the one in the query's place.
    """
    recorded = F.from_json(F.element_at("queries", ERRORS_KEY), "map<string,string>")
    recorded = F.coalesce(recorded, F.expr("cast(map() as map<string,string>)"))
    in_place = F.transform_values(F.map_filter("queries", lambda k, _: k != ERRORS_KEY), lambda _, v: F.get_json_object(v, "$.error"))
    left = F.map_filter(in_place, lambda k, v: v.isNotNull() & ~F.map_contains_key(recorded, k))
    return documents.select("engine", "size", F.explode(F.map_concat(recorded, left)).alias("query", "message"))


def skipped_runs(documents: DataFrame) -> DataFrame:
    """One row per engine and size that was not run: ``engine, size, reason``."""
    return documents.where("skipped").select("engine", "size", "reason")


#: Fixed value: what the engine of a vector document begins with.
VECTOR_PREFIX = "vec_"


def graph_documents(documents: DataFrame) -> DataFrame:
    """The documents of graph runs; those of vector runs of the same engines are no rivals of them."""
    return documents.where(~F.startswith("engine", F.lit(VECTOR_PREFIX)))


def vector_documents(documents: DataFrame) -> DataFrame:
    """The documents of vector runs, under their engine's own name."""
    own = F.expr(f"substring(engine, {len(VECTOR_PREFIX) + 1})")
    return documents.where(F.startswith("engine", F.lit(VECTOR_PREFIX))).withColumn("engine", own)
