"""A property graph, vectors and timing samples derived from the commerce tables.

Every row of the source tables becomes a node or edges. A node id is the code of
its category times :data:`ID_SPACE` plus the row's key; the space leaves room for
10^15 keys per category and keeps every id below 2^53.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline.functions.epoch import epoch_ms, instant
from hopline.model import PropertyGraph

# Category codes, the id space, engine and size labels.
ID_SPACE = 10**15
CODES = {"customer": 1, "order": 2, "part": 3, "supplier": 4, "nation": 5, "region": 6}
ENGINES = ["engine_0", "engine_1", "engine_2"]
SIZES = ["small", "large"]


def node_id(category: str, key: int) -> int:
    return CODES[category] * ID_SPACE + key


def _id(category: str, key: str) -> Column:
    return F.lit(CODES[category] * ID_SPACE) + F.col(key).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commerce_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The source tables of the graph, each opened once."""
    names = ["customer", "orders", "lineitem", "part", "supplier", "nation", "region"]
    return {name: table(spark, sf_dir, name) for name in names}


def _keys(category: str, ids: Sequence[int] | None) -> list[int] | None:
    """Keys of the ids that belong to a category; None stands for all rows."""
    if ids is None:
        return None
    return [i - CODES[category] * ID_SPACE for i in ids if i // ID_SPACE == CODES[category]]


def _with_keys(source: DataFrame, key: str, keys: list[int] | None) -> DataFrame:
    return source if keys is None else source.where(F.col(key).isin(keys))


def commerce_nodes(tables: dict[str, DataFrame], ids: Sequence[int] | None = None) -> DataFrame:
    """All nodes, or those of ``ids``, whose keys then filter the scans of their own tables."""

    def part(name, category, key, value=None, ts=None):
        keys = _keys(category, ids)
        source = _with_keys(tables[name], key, keys)
        return keys != [] and source.select(
            _id(category, key).alias("id"),
            F.lit(category).alias("category"),
            (F.col(value).cast("double") if value else F.lit(0.0)).alias("value"),
            (epoch_ms(source, ts) if ts else F.lit(0).cast("long")).alias("ts"),
        )

    parts = [
        part("customer", "customer", "c_custkey", "c_acctbal"),
        part("orders", "order", "o_orderkey", "o_totalprice", "o_orderdate"),
        part("part", "part", "p_partkey", "p_retailprice"),
        part("supplier", "supplier", "s_suppkey", "s_acctbal"),
        part("nation", "nation", "n_nationkey"),
        part("region", "region", "r_regionkey"),
    ]
    kept = [p for p in parts if p is not False]
    return reduce(DataFrame.unionByName, kept) if kept else commerce_nodes(tables).limit(0)


ORDERED = (("customer", "o_custkey"), ("order", "o_orderkey"))
ITEM = (("order", "l_orderkey"), ("part", "l_partkey"), ("supplier", "l_suppkey"))

#: Table, edge type, source, target, time column.
EDGES = (
    ("orders", "placed", ORDERED[0], ORDERED[1], "o_orderdate"),
    ("orders", "placed_by", ORDERED[1], ORDERED[0], "o_orderdate"),
    ("lineitem", "contains", ITEM[0], ITEM[1], "l_shipdate"),
    ("lineitem", "contained_in", ITEM[1], ITEM[0], "l_shipdate"),
    ("lineitem", "supplied_by", ITEM[1], ITEM[2], "l_shipdate"),
    ("customer", "located_in", ("customer", "c_custkey"), ("nation", "c_nationkey"), None),
    ("supplier", "located_in", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), None),
    ("nation", "part_of", ("nation", "n_nationkey"), ("region", "n_regionkey"), None),
)


def commerce_edges(
    tables: dict[str, DataFrame],
    sources: Sequence[int] | None = None,
    window: tuple[int, int] | None = None,
) -> DataFrame:
    """All edges, each table scanned once; or only those that leave ``sources`` or lie in ``window``.

    Source ids become keys, and a time window becomes bounds of the time column, that
    filter the scans; kinds of edges that cannot qualify are left out.
    """

    def edge(source, edge_type, src, dst, ts):
        return F.struct(
            _id(*src).alias("src"),
            _id(*dst).alias("dst"),
            F.lit(edge_type).alias("edge_type"),
            (epoch_ms(source, ts) if ts else F.lit(0).cast("long")).alias("ts"),
        )

    def in_window(source, ts):
        if window is None:
            return source
        if ts is None:
            return source if window[0] <= 0 <= window[1] else None
        low, high = (instant(source, ts, t) for t in (window[0], window[1] + 1))
        return source.where((F.col(ts) >= low) & (F.col(ts) < high))

    by_table: dict[str, list] = {}
    for name, *kind in EDGES:
        by_table.setdefault(name, []).append(kind)
    parts = []
    for name, kinds in by_table.items():
        source = in_window(tables[name], kinds[0][3])
        if source is None:
            continue
        if sources is None:
            made = [edge(source, *kind) for kind in kinds]
            parts.append(source.select(F.inline(F.array(*made))) if len(made) > 1 else source.select(made[0].alias("e")).select("e.*"))
            continue
        for kind in kinds:
            keys = _keys(kind[1][0], sources)
            if keys:
                leaving = _with_keys(source, kind[1][1], keys)
                parts.append(leaving.select(edge(leaving, *kind).alias("e")).select("e.*"))
    return reduce(DataFrame.unionByName, parts) if parts else commerce_edges(tables).limit(0)


def commerce_graph(
    spark: SparkSession,
    sf_dir: str,
    ids: Sequence[int] | None = None,
    sources: Sequence[int] | None = None,
    window: tuple[int, int] | None = None,
) -> PropertyGraph:
    """The graph, or the part that a lookup needs: nodes ``ids``, edges from ``sources`` or in ``window``.

    Every endpoint is a row of its own table, so none is missing.
    """
    tables = commerce_tables(spark, sf_dir)
    nodes, edges = commerce_nodes(tables, ids), commerce_edges(tables, sources, window)
    return PropertyGraph.of(nodes, edges, endpoints_ok=True)


def commerce_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, embedding)``: the embedding of a part under the part's node id."""
    return table(spark, sf_dir, "embeddings").select(_id("part", "vec_id").alias("id"), "embedding")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(engine, size, query, seq, value)``: events read as timing samples."""
    user = F.col("user_id")
    engine = F.concat(F.lit("engine_"), (user % 3).cast("string"))
    size = F.when(user % 2 == 0, SIZES[0]).otherwise(SIZES[1])
    return table(spark, sf_dir, "events").select(
        engine.alias("engine"),
        size.alias("size"),
        F.col("event_type").alias("query"),
        F.col("event_id").alias("seq"),
        "value",
    )
