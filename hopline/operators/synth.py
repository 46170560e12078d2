"""Reproducible synthetic graph tables, made row by row from keys.

Every column is a hash of the row's key, the seed and the column's name, so a row
does not depend on partitioning, on other rows, or on a retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.functions.hashing import uniform_int, uniform_real
from hopline.operators.kernels import task_vectors

# The domains of the generated columns.
SEED = 42
EMBED_DIM = 128
CATEGORIES = ["person", "org", "location", "event", "product", "topic", "resource", "service"]
EDGE_TYPES = ["knows", "works_at", "located_in", "part_of", "related_to"]
TS_BASE = 1704067200000
TS_SPAN = 365 * 24 * 3600 * 1000


def _choice(values: list[str], key, seed: int, stream: str):
    options = F.array(*[F.lit(v) for v in values])
    return F.get(options, (uniform_int(key, seed, stream) % len(values)).cast("int"))


def _instant(key, seed: int, stream: str):
    return F.lit(TS_BASE) + uniform_int(key, seed, stream) % TS_SPAN


def nodes_for(keys: DataFrame, seed: int = SEED, key: str = "id") -> DataFrame:
    """One node per key: uniform category, value in [0, 1) and time within a year."""
    k = F.col(key)
    return keys.select(
        k.cast("long").alias("id"),
        _choice(CATEGORIES, k, seed, "category").alias("category"),
        uniform_real(k, seed, "value").alias("value"),
        _instant(k, seed, "node_ts").alias("ts"),
    )


def edges_for(keys: DataFrame, nodes: int, seed: int = SEED, key: str = "id") -> DataFrame:
    """One directed edge per key between nodes ``0 … nodes - 1``, never a self-loop.

    The target is a uniform step of 1 to ``nodes - 1`` round the circle of ids, so
    nothing has to be drawn again.
    """
    if nodes < 2:
        raise ValueError("edges without self-loops need at least two nodes")
    k = F.col(key)
    src = uniform_int(k, seed, "src") % nodes
    step = uniform_int(k, seed, "dst") % (nodes - 1)
    return keys.select(
        src.alias("src"),
        ((src + 1 + step) % nodes).alias("dst"),
        _choice(EDGE_TYPES, k, seed, "edge_type").alias("edge_type"),
        _instant(k, seed, "edge_ts").alias("ts"),
    )


def with_vectors(
    df: DataFrame, dim: int = EMBED_DIM, seed: int = SEED, key: str = "id"
) -> DataFrame:
    """``df`` with an ``embedding``: a standard normal direction per key, of length one.

    Keys are 64-bit integers. The draws are counter-based: key, seed and place in
    the vector decide each of them.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )
    return df.mapInArrow(task_vectors(df.columns.index(key), dim, seed), schema)


def generate_nodes(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """Nodes ``0 … n - 1``."""
    return nodes_for(spark.range(n), seed)


def generate_edges(spark: SparkSession, nodes: int, edges: int, seed: int = SEED) -> DataFrame:
    """``edges`` edges between nodes ``0 … nodes - 1``."""
    return edges_for(spark.range(edges), nodes, seed)


def generate_vector_nodes(
    spark: SparkSession, n: int, dim: int = EMBED_DIM, seed: int = SEED
) -> DataFrame:
    """Nodes ``0 … n - 1`` with a unit vector each."""
    return with_vectors(nodes_for(spark.range(n), seed), dim, seed)
