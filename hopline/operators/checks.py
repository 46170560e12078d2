"""Key and endpoint checks, run as jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.model import PropertyGraph, missing_ids
from hopline.plans.lineage import settle


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or contain a null, with their row count ``n``."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.where((F.col("n") > 1) | missing)


def missing_endpoints(graph: PropertyGraph) -> DataFrame:
    """``(side, node, n)``: endpoints that are no node, and how many edges use them."""
    return (
        missing_ids(graph.edges, graph.nodes)
        .unpivot("node", ["src", "dst"], "side", "n")
        .where(F.col("n") > 0)
        .select("side", "node", "n")
    )


def wrong_vectors(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector is missing or not ``dim`` long."""
    return df.where(F.col(column).isNull() | (F.size(column) != dim))


@dataclass(frozen=True)
class KeyFilter:
    """A stored Bloom filter of keys: blocks of ``hashes`` words, below ``path`` by stretches of blocks.

    A key sets one bit in each word of one block, so it is moved once, as its block and one
    hash that says which bits. Keys that were added always pass; of others about one in 1,000
    does, at 16 bits a key.
    """

    path: str
    keys: tuple[str, ...]
    bits: int
    hashes: int

    @property
    def words(self) -> list[str]:
        return [f"w{n}" for n in range(self.hashes)]

    @property
    def schema(self) -> str:
        return ", ".join(f"{name} long" for name in ["block", *self.words, "stretch"])

    def _block(self) -> Column:
        blocks = max(1, -(-self.bits // (64 * self.hashes)))
        return F.pmod(F.xxhash64(F.lit(0), *self.keys), F.lit(blocks)).alias("block")

    def _spots(self) -> list[Column]:
        """Hashes of which every six bits choose the bit of a word."""
        return [F.xxhash64(F.lit(n + 1), *self.keys).alias(f"spots{n}") for n in range(-(-self.hashes // SPOTS))]

    def _masks(self) -> list[Column]:
        place = "(shiftrightunsigned(spots{}, {}) & 63L)"
        return [F.expr(f"shiftleft(1L, cast({place.format(n // SPOTS, 6 * (n % SPOTS))} as int))") for n in range(self.hashes)]

    def add(self, rows: DataFrame) -> KeyFilter:
        """Put the keys of ``rows`` in. Adding keys twice changes nothing."""
        # dealt out as hashes; each block's words are put together where its keys have come
        dealt = rows.select(self._block(), *self._spots()).repartition("block")
        words = [F.bit_or(mask).alias(word) for word, mask in zip(self.words, self._masks())]
        stretch = F.shiftright("block", STRETCH_BITS).alias("stretch")
        blocks = dealt.groupBy("block").agg(*words).select("block", *self.words, stretch)
        blocks.write.mode("append").partitionBy("stretch").parquet(f"{self.path}/words")
        return self

    def may_hold(self, rows: DataFrame) -> DataFrame:
        """The different keys of ``rows`` that pass the filter.

        The probes are brought to the filter's words; what the filter stands for is not read.
        """
        stored = rows.sparkSession.read.schema(self.schema).parquet(f"{self.path}/words")
        blocks = stored.groupBy("block").agg(*[F.bit_or(word).alias(word) for word in self.words])
        found = rows.select(*self.keys, self._block(), *self._spots()).join(blocks, "block")
        holds = [F.col(word).bitwiseAND(mask) != 0 for word, mask in zip(self.words, self._masks())]
        return found.where(reduce(lambda a, b: a & b, holds)).select(*self.keys).distinct()


#: Blocks of a filter in one folder, as a power of two.
STRETCH_BITS = 24
#: Places among 64 bits that one hash gives.
SPOTS = 10


def store_key_filter(
    rows: DataFrame, path: str, keys: Sequence[str], expected: int | None = None, bits_per_key: int = 16, hashes: int = 7
) -> KeyFilter:
    """A filter of the keys of ``rows``, sized for ``expected`` keys (by default twice the rows)."""
    spark = rows.sparkSession
    n = expected if expected is not None else 2 * rows.count()
    made = KeyFilter(path, tuple(keys), max(64, n * bits_per_key), hashes)
    empty = spark.createDataFrame([], made.schema)
    empty.write.mode("overwrite").parquet(f"{path}/words")
    made.add(rows)
    kept = spark.createDataFrame([(list(keys), made.bits, hashes)], "keys array<string>, bits long, hashes int")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    return made


def open_key_filter(spark: SparkSession, path: str) -> KeyFilter:
    """A filter that :func:`store_key_filter` has written."""
    row = spark.read.parquet(f"{path}/_manifest").first()
    return KeyFilter(path, tuple(row["keys"]), row.bits, row.hashes)


def batch_key_violations(graph: PropertyGraph, stored: KeyFilter, batch: DataFrame) -> DataFrame:
    """Keys of a new batch of edges that occur more than once in stored edges and batch together.

    ``(*keys, n)``, as :func:`key_violations` gives for all edges, of the keys that the batch
    has; keys with a null count as well. Keys that do not pass the filter are new for certain.
    Only those that do are looked up, in the edges of their sources; with a layout by source,
    in their folders.
    """
    keys = list(stored.keys)
    counted = batch.groupBy(*keys).agg(F.count("*").alias("n"))
    suspects = settle(stored.may_hold(batch), graph.limits)
    found = None if suspects.head is None else {row.src for row in suspects.head}
    edges = graph.edges if found is None or None in found else graph.edges_at("src", sorted(found))
    few = F.broadcast(suspects.df) if suspects.rows <= graph.limits.broadcast_rows else suspects.df
    pairs = few.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    old = edges.join(pairs, same, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
    both = counted.unionByName(old).groupBy(*keys).agg(F.sum("n").alias("n"))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return both.where((F.col("n") > 1) | missing)


def batch_missing_endpoints(graph: PropertyGraph, batch: DataFrame) -> DataFrame:
    """:func:`missing_endpoints` of a new batch alone: stored edges are not read."""
    return missing_endpoints(replace(graph.with_edges(batch), endpoints_ok=False))
