"""The property graph: one node table and one edge table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopline.plans.limits import DEFAULT_LIMITS, Limits
from hopline.plans.lineage import cut, settle
from hopline.plans.skew import hub_table, in_list, match_keys

NODE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("ts", T.LongType()),
    ]
)

EDGE_SCHEMA = T.StructType(
    [
        T.StructField("src", T.LongType()),
        T.StructField("dst", T.LongType()),
        T.StructField("edge_type", T.StringType()),
        T.StructField("ts", T.LongType()),
    ]
)

VECTOR_NODE_SCHEMA = T.StructType(
    NODE_SCHEMA.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns by name and cast them to its types.

    A value that does not fit its type fails the job, whatever the session's
    ANSI setting. Columns that already have the type are passed through
    untouched, so filters on them still reach the scan.
    """
    columns = []
    for want in schema.fields:
        have = df.schema[want.name].dataType
        source = F.col(want.name)
        if have == want.dataType or (
            isinstance(have, T.ArrayType)
            and isinstance(want.dataType, T.ArrayType)
            and have.elementType == want.dataType.elementType
        ):
            columns.append(source)
            continue
        fitted = source.try_cast(want.dataType)
        message = F.concat(
            F.lit(f"{want.name} does not fit {want.dataType.simpleString()}: "),
            source.cast("string"),
        )
        failure = F.raise_error(message).cast(want.dataType)
        misfit = source.isNotNull() & fitted.isNull()
        columns.append(F.when(misfit, failure).otherwise(fitted).alias(want.name))
    return df.select(*columns)


@dataclass(frozen=True)
class Layout:
    """Edges stored by one of their ends, in a folder per ``bucket``: the end modulo ``buckets``."""

    df: DataFrame
    buckets: int

    def at(self, key: str, ids: list[int]) -> DataFrame:
        """The edges with one of a few keys; other buckets' folders are not read."""
        wanted = sorted({i % self.buckets for i in ids})
        return self.df.where(F.col("bucket").isin(wanted) & in_list(key, ids)).drop("bucket")

    def where(self, condition: Column) -> Layout:
        return replace(self, df=self.df.where(condition))

    def turned(self) -> Layout:
        return replace(self, df=turned(self.df))


def turned(edges: DataFrame) -> DataFrame:
    """Edges turned round."""
    names = {"src": "dst", "dst": "src"}
    order = [c for c in ("dst", "src", "edge_type", "ts", "bucket") if c in edges.columns]
    return edges.select(*[F.col(c).alias(names.get(c, c)) for c in order])


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes ``(id, category, value, ts)`` and directed edges ``(src, dst, edge_type, ts)``.

    ``endpoints_ok`` records that the endpoint check found nothing: traversals then
    skip the joins that would drop edges to missing nodes.
    """

    nodes: DataFrame
    edges: DataFrame
    endpoints_ok: bool = False
    limits: Limits = DEFAULT_LIMITS
    #: The edges stored in two parts, without and with hub sources; see ``split_edges``.
    parts: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False, compare=False)
    #: The same edges stored by ``src`` and by ``dst``, if they are; see ``store_graph``.
    layouts: dict[str, Layout] = field(default_factory=dict, repr=False, compare=False)
    _hubs: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, **kwargs) -> PropertyGraph:
        """A graph over any two tables that hold the contract's columns."""
        return cls(conform(nodes, NODE_SCHEMA), conform(edges, EDGE_SCHEMA), **kwargs)

    def edges_at(self, key: str, ids: list[int]) -> DataFrame:
        """The edges whose ``key`` is one of a few ids, from the layout by that key if there is one."""
        if key in self.layouts:
            return self.layouts[key].at(key, ids)
        return self.edges.where(in_list(key, ids))

    def hubs(self, key: str) -> DataFrame:
        """Heavy values of ``src`` or ``dst``; counted once per graph, on first use."""
        if key not in self._hubs:
            self._hubs[key] = hub_table(self.edges, key, self.limits)
        return self._hubs[key]

    def split_hubs(self) -> DataFrame:
        """``(hub, splits)`` of the hubs by which the edges are split.

        Stored parts bring their own: a hub is whatever source the hot part holds,
        whatever the bounds of this graph say.
        """
        if self.parts is None:
            return self.hubs("src")
        if "parts" not in self._hubs:
            counted = self.parts[1].groupBy(F.col("src").alias("hub")).agg(F.count("*").alias("n"))
            splits = F.ceil(F.col("n") / self.limits.hub_rows).cast("int").alias("splits")
            self._hubs["parts"] = cut(counted.select("hub", splits))
        return self._hubs["parts"]

    def cold_and_hot(self) -> tuple[DataFrame, DataFrame]:
        """The edges of ordinary sources and the edges of hub sources."""
        if self.parts is not None:
            return self.parts
        hubs = F.broadcast(self.hubs("src"))
        is_hub = F.col("src") == F.col("hub")
        return (
            self.edges.join(hubs, is_hub, "left_anti"),
            self.edges.join(hubs, is_hub, "left_semi"),
        )

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        """The same nodes with other edges."""
        return replace(self, edges=edges, parts=None, layouts={}, _hubs={})

    def where_edges(self, condition: Column) -> PropertyGraph:
        """The subgraph of the edges that meet ``condition``.

        Parts stored apart stay apart (a source is no heavier in the subgraph), and so do layouts.
        """
        parts = tuple(part.where(condition) for part in self.parts) if self.parts else None
        layouts = {key: layout.where(condition) for key, layout in self.layouts.items()}
        edges = self.edges.where(condition)
        return replace(self, edges=edges, parts=parts, layouts=layouts, _hubs={})

    def reversed(self) -> PropertyGraph:
        """The graph with every edge turned round; layouts by the one end serve the other."""
        other = {"src": "dst", "dst": "src"}
        layouts = {other[key]: layout.turned() for key, layout in self.layouts.items()}
        return replace(self.with_edges(turned(self.edges)), layouts=layouts)

    def existing(self, ids: DataFrame, key: str = "node") -> DataFrame:
        """Rows of ``ids`` whose ``key`` is a node of the graph."""
        if self.endpoints_ok:
            return ids
        return ids.join(self.nodes.select("id"), F.col(key) == F.col("id"), "left_semi")

    def checked(self) -> PropertyGraph:
        """The graph without the edges that lead from or to a missing node.

        Missing nodes are looked for once, counted per endpoint; usually there are
        none and the edges are used as they are.
        """
        if self.endpoints_ok:
            return self
        used = missing_ids(self.edges, self.nodes).select("node")
        missing = settle(used.where(F.col("node").isNotNull()), self.limits)
        edges = self.edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        if missing.rows:
            for side in ("src", "dst"):
                edges = match_keys(self, edges, side, missing, "left_anti")
            return replace(self.with_edges(edges), endpoints_ok=True)
        return replace(self, endpoints_ok=True)


def missing_ids(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, src, dst)``: endpoints that are no node, with their edges on either side.

    One scan of the edges. They are counted per endpoint before any join, so a hub
    contributes one row per task, and the anti-join reuses that partitioning.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), one.alias("as_src"), none.alias("as_dst")),
                F.struct(F.col("dst").alias("node"), none.alias("as_src"), one.alias("as_dst")),
            )
        )
    )
    counted = ends.groupBy("node").agg(F.sum("as_src").alias("src"), F.sum("as_dst").alias("dst"))
    return counted.join(nodes.select("id"), F.col("node") == F.col("id"), "left_anti")
