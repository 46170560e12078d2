"""Breadth-first search: reachability, shortest lengths, routes, many pairs.

Each round is one job over the edge table with the current frontier, ended by a
lineage cut; the driver keeps only counts and small key lists. A path has at
least one edge, so a node's path to itself is its shortest cycle.

Among equally short routes the one built from the smallest predecessor at every
step, going back from the target, is returned.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hopline.model import PropertyGraph
from hopline.plans.limits import Limits
from hopline.plans.lineage import Settled, cut, scratch_path, settle
from hopline.plans.skew import expand, in_list, leaving
from hopline.sources.tables import split_edges

#: Earlier levels are kept as one table once there are more than this many.
LEVELS_APART = 8


class Visited:
    """``(root, node)`` pairs already reached.

    While they are few they are broadcast. More are kept in a table bucketed by the pair:
    each level is dealt out to the buckets once, when it is appended, and stays there; later
    rounds bring their arrivals to the buckets and shuffle nothing that was visited before.
    Used as a context; the table goes when it ends.
    """

    def __init__(self, limits: Limits):
        self.limits, self.tables, self.rows = limits, [], 0
        self.spark = self.name = self.path = None
        self.buckets = 0

    def __enter__(self) -> Visited:
        return self

    def __exit__(self, *_) -> None:
        if self.name:
            _drop(self.spark, self.name, self.path)
            self.name = None

    def add(self, level: Settled) -> None:
        pairs = level.df.select("root", "node")
        self.rows += level.rows
        if self.name:
            self._store(pairs)
            return
        self.tables.append(pairs)
        if self.rows > self.limits.broadcast_rows:
            self.spark = level.df.sparkSession
            self.path = scratch_path(self.spark, "visited")
            self.name = f"visited_{uuid.uuid4().hex}"
            self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self._store(reduce(DataFrame.unionByName, self.tables))
        elif len(self.tables) > LEVELS_APART:
            self.tables = [cut(reduce(DataFrame.unionByName, self.tables))]

    def _store(self, pairs: DataFrame) -> None:
        dealt = pairs.repartition(self.buckets, "root", "node").write.mode("append")
        dealt.option("path", self.path).bucketBy(self.buckets, "root", "node").saveAsTable(self.name)

    def unseen(self, arrivals: DataFrame) -> DataFrame:
        """Arrivals at pairs that no level holds."""
        if not self.tables:
            return arrivals
        if self.name:
            visited = self.spark.table(self.name)
        else:
            visited = F.broadcast(reduce(DataFrame.unionByName, self.tables))
        return arrivals.join(visited, ["root", "node"], "left_anti")


class Dealt:
    """A graph whose edges are dealt out to buckets by source once, for all later rounds.

    While frontiers may be broadcast, the edges are read where they are. The first one that
    is larger has ``(src, dst)`` of all edges stored by ``split_edges``; from then on rounds
    shuffle their frontier and arrivals only. Used as a context; the tables go when it ends.
    """

    #: Edges in a bucket, so that a task sorts them in memory.
    BUCKET_ROWS = 4_000_000

    def __init__(self, graph: PropertyGraph):
        self.graph, self.name, self.path = graph, None, None

    def __enter__(self) -> Dealt:
        return self

    def __exit__(self, *_) -> None:
        if self.name:
            _drop(self.graph.nodes.sparkSession, self.name, self.path)
            self.name = None

    def before(self, frontier: Settled) -> PropertyGraph:
        """The graph to extend ``frontier`` in."""
        if frontier.rows > self.graph.limits.broadcast_rows and self.graph.parts is None:
            spark = self.graph.nodes.sparkSession
            pairs = self.graph.with_edges(self.graph.edges.select("src", "dst").where("src is not null"))
            least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            buckets = max(least, -(-pairs.edges.count() // self.BUCKET_ROWS))
            self.path, self.name = scratch_path(spark, "dealt"), f"dealt_{uuid.uuid4().hex}"
            self.graph = split_edges(pairs, self.path, self.name, buckets)
        return self.graph


def _drop(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"drop table if exists {name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _start(spark: SparkSession, node: int) -> Settled:
    df = spark.sql(f"select {int(node)}L as root, {int(node)}L as node")
    return Settled(df, 1, [Row(root=int(node), node=int(node))])


def _next_level(
    graph: PropertyGraph, frontier: Settled, seen: Visited, root: int | None = None, parents: bool = True
) -> DataFrame:
    """``(root, node, parent)`` first reached one edge beyond the frontier, or without ``parent``.

    With a single ``root`` the frontier is only a list of sources.
    """
    if root is None:
        step = expand(graph, frontier)
    else:
        step = leaving(graph, frontier).withColumn("root", F.lit(root).cast("long"))
    arrivals = step.select("root", F.col("dst").alias("node"), F.col("src").alias("parent"))
    if parents:
        arrivals = arrivals.groupBy("root", "node").agg(F.min("parent").alias("parent"))
    else:
        arrivals = arrivals.select("root", "node").distinct()
    return _existing(graph, seen.unseen(arrivals))


def _existing(graph: PropertyGraph, arrivals: DataFrame) -> DataFrame:
    """Arrivals at nodes of the graph; a few are looked up, and the nodes stay where they are.

    A join with all nodes would bring them to the driver, as a broadcast, in every round of
    a long search if they are just small enough for one.
    """
    if graph.endpoints_ok:
        return arrivals
    fresh = settle(arrivals.where("node is not null"), graph.limits)
    few = fresh.literals("node")
    if few is None:
        return graph.existing(fresh.df)
    known = graph.nodes.where(in_list("id", few)).select("id").distinct()
    return fresh.df.join(F.broadcast(known), F.col("node") == F.col("id"), "left_semi")


def reach(graph: PropertyGraph, source: int, max_hops: int | None = None) -> DataFrame:
    """``(node, distance)`` for every node that ``source`` reaches, itself at 0.

    With ``max_hops`` only nodes within so many edges are returned, and a column
    ``bound_hit`` says whether the search ended there with nodes still to leave from.
    """
    here = graph.nodes.where(F.col("id") == source)
    levels = [settle(here.select(F.col("id").alias("root"), F.col("id").alias("node")), graph.limits)]
    with Visited(graph.limits) as seen, Dealt(graph) as dealt:
        while levels[-1].rows and (max_hops is None or len(levels) <= max_hops):
            seen.add(levels[-1])
            step = _next_level(dealt.before(levels[-1]), levels[-1], seen, source, parents=False)
            levels.append(settle(step, graph.limits))
    found = [
        level.df.select("node", F.lit(depth).cast("long").alias("distance"))
        for depth, level in enumerate(levels)
    ]
    reached = reduce(DataFrame.unionByName, found)
    if max_hops is None:
        return reached
    return reached.withColumn("bound_hit", F.lit(levels[-1].rows > 0))


@dataclass
class PathSearch:
    """Levels of a finished search. Level ``i`` holds the nodes ``i`` edges from the root.

    ``bound_hit`` tells whether the search gave up at the hop bound; without it, a
    missing pair has no path at all.
    """

    levels: list[Settled]
    hits: list[int] = field(default_factory=list)
    bound_hit: bool = False

    def lengths(self, spark: SparkSession) -> DataFrame:
        """``(source, target, length)`` for every pair that is connected."""
        found = [
            level.df.where("hit").select(
                F.col("root").alias("source"),
                F.col("node").alias("target"),
                F.lit(depth).cast("long").alias("length"),
            )
            for depth, (level, hits) in enumerate(zip(self.levels, self.hits))
            if hits
        ]
        if not found:
            return spark.createDataFrame([], "source long, target long, length long")
        return reduce(DataFrame.unionByName, found)

    def routes(self, spark: SparkSession, bound: int) -> DataFrame:
        """``(source, target, step, node)``: one shortest route per connected pair."""
        open_routes, carried = None, 0
        for level, hits in reversed(list(zip(self.levels, self.hits))[1:]):
            parts = []
            if open_routes is not None:
                pending = F.broadcast(open_routes) if carried <= bound else open_routes
                parts.append(
                    level.df.select("root", "node", "parent")
                    .join(pending, ["root", "node"])
                    .select(
                        "root",
                        "target",
                        F.col("parent").alias("node"),
                        F.concat(F.array("parent"), "route").alias("route"),
                    )
                )
            if hits:
                parts.append(
                    level.df.where("hit").select(
                        "root",
                        F.col("node").alias("target"),
                        F.col("parent").alias("node"),
                        F.array("parent", "node").alias("route"),
                    )
                )
            if parts:
                open_routes, carried = reduce(DataFrame.unionByName, parts), carried + hits
        if open_routes is None:
            return spark.createDataFrame([], "source long, target long, step long, node long")
        return open_routes.select(
            F.col("root").alias("source"), "target", F.posexplode("route").alias("step", "node")
        ).select("source", "target", F.col("step").cast("long").alias("step"), "node")


def _common(new: Settled, other: Settled, limits: Limits) -> Settled:
    """``(node)``: what two opposite frontiers share; no job when both are short lists."""
    spark = new.df.sparkSession
    ours, theirs = new.literals("node"), other.literals("node")
    if ours is None and theirs is None:
        return settle(new.df.join(other.df.select("node"), "node", "left_semi"), limits)
    if ours is not None and theirs is not None:
        shared = sorted(set(ours) & set(theirs))
    else:
        (known, frontier) = (theirs, new) if ours is None else (ours, other)
        rows = frontier.df.where(in_list("node", known)).select("node").distinct().collect()
        shared = sorted(r.node for r in rows)
    relation = spark.createDataFrame(pa.table({"node": pa.array(shared, pa.int64())}))
    return Settled(relation, len(shared), [Row(node=n) for n in shared])


def search_pair(
    graph: PropertyGraph, source: int, target: int, max_hops: int | None = None, routes: bool = True
) -> PathSearch:
    """Shortest path between two nodes, searched from both ends.

    Each round extends the smaller frontier by one edge. No path is as short as
    the depths searched so far, so the first common node of the two frontiers ends
    the search. Sets ``hit`` on the last level; with ``routes`` unset that level
    tells the length only.
    """
    with (
        Visited(graph.limits) as ahead, Visited(graph.limits) as behind,
        Dealt(graph) as onward, Dealt(graph.reversed()) as back,
    ):
        seen, dealt = {True: ahead, False: behind}, {True: onward, False: back}
        return _search_pair(graph, source, target, max_hops, routes, seen, dealt)


def _search_pair(
    graph: PropertyGraph, source: int, target: int, max_hops: int | None, routes: bool, seen: dict, dealt: dict
) -> PathSearch:
    spark = graph.nodes.sparkSession
    forward, backward = [_start(spark, source)], [_start(spark, target)]
    if not graph.endpoints_ok:
        known = graph.nodes.where(F.col("id").isin(source, target)).select("id").distinct()
        if known.count() < len({source, target}):
            return PathSearch(forward, [0])
    while True:
        if max_hops is not None and len(forward) + len(backward) - 2 >= max_hops:
            return PathSearch(forward, [0] * len(forward), bound_hit=True)
        ahead = forward[-1].rows <= backward[-1].rows
        side, other = (forward, backward) if ahead else (backward, forward)
        start = source if ahead else target
        level = settle(_next_level(dealt[ahead].before(side[-1]), side[-1], seen[ahead], start), graph.limits)
        side.append(level)
        seen[ahead].add(level)
        if level.rows == 0:
            return PathSearch(forward, [0] * len(forward))
        common = _common(level, other[-1], graph.limits)
        if common.rows:
            break
    depth = len(forward) + len(backward) - 2
    found = F.lit(True).alias("hit")
    if not routes:
        pair = spark.sql(
            f"select {int(source)}L as root, {int(target)}L as node, cast(null as long) as parent"
        ).withColumn("hit", F.lit(True))
        blank = forward[0]
        return PathSearch([blank] * depth + [Settled(pair, 1, None)], [0] * depth + [1])
    # Second half of the route: from the common nodes to the target, through the
    # backward levels, keeping only nodes that lie on a shortest path.
    here, levels = common, list(forward)
    for nearer in reversed(backward[:-1]):
        arrivals = _next_level(dealt[True].before(here), here, Visited(graph.limits), source)
        near = nearer.df.select("node")
        near = F.broadcast(near) if nearer.rows <= graph.limits.broadcast_rows else near
        here = settle(arrivals.join(near, "node", "left_semi"), graph.limits)
        levels.append(here)
    last = levels[-1].df.where(F.col("node") == target).select("root", "node", "parent", found)
    levels[-1] = Settled(last, 1, None)
    return PathSearch(levels, [0] * depth + [1])


def shortest_length(
    graph: PropertyGraph, source: int, target: int, max_hops: int | None = None
) -> DataFrame:
    """``(source, target, length)``; no row when there is no path.

    With ``max_hops`` there is a column ``bound_hit``; where the search gave up at the
    bound, the pair comes back with it set and no length.
    """
    search = search_pair(graph, source, target, max_hops, routes=False)
    return _with_bound(search.lengths(graph.nodes.sparkSession), search, max_hops, source, target)


def _with_bound(
    found: DataFrame, search: PathSearch, max_hops: int | None, source: int, target: int
) -> DataFrame:
    if max_hops is None:
        return found
    if not search.bound_hit:
        return found.withColumn("bound_hit", F.lit(False))
    return found.sparkSession.sql(
        f"select {int(source)}L as source, {int(target)}L as target, "
        "cast(null as long) as length, true as bound_hit"
    )


def shortest_route(
    graph: PropertyGraph, source: int, target: int, max_hops: int | None = None
) -> DataFrame:
    """``(source, target, step, node)``: the nodes of one shortest route, in order."""
    search = search_pair(graph, source, target, max_hops)
    return search.routes(graph.nodes.sparkSession, graph.limits.broadcast_rows)


def search_many(
    graph: PropertyGraph, sources: DataFrame, targets: DataFrame, max_hops: int | None = None
) -> PathSearch:
    """Shortest paths from every source to every target.

    ``sources`` and ``targets`` are tables with a ``node`` column. The frontier is
    keyed ``(root, node)``; a root whose targets are all found is dropped from it.
    """
    with Visited(graph.limits) as seen, Dealt(graph) as dealt:
        return _search_many(graph, sources, targets, max_hops, seen, dealt)


def _search_many(
    graph: PropertyGraph, sources: DataFrame, targets: DataFrame, max_hops: int | None, seen: Visited, dealt: Dealt
) -> PathSearch:
    bound = graph.limits.broadcast_rows
    goals = settle(graph.existing(targets.select("node").distinct()), graph.limits)
    starts = settle(
        graph.existing(sources.select("node").distinct()).select(
            F.col("node").alias("root"), "node"
        ),
        graph.limits,
    )
    search = PathSearch([starts], [0])
    frontier = starts
    goal_flag = goals.df.select("node", F.lit(True).alias("hit"))
    if goals.rows <= bound:
        goal_flag = F.broadcast(goal_flag)
    while frontier.rows and sum(search.hits) < starts.rows * goals.rows:
        if max_hops is not None and len(search.levels) > max_hops:
            search.bound_hit = True
            break
        level = _next_level(dealt.before(frontier), frontier, seen)
        level = level.join(goal_flag, "node", "left").select(
            "root", "node", "parent", F.coalesce("hit", F.lit(False)).alias("hit")
        )
        level = settle(level, graph.limits)
        hits = (
            sum(row.hit for row in level.head)
            if level.head is not None
            else level.df.where("hit").count()
        )
        search.levels.append(level)
        seen.add(level)
        search.hits.append(hits)
        frontier = _open_part(search, level, starts, goals.rows, bound) if hits else level
    return search


def _open_part(
    search: PathSearch, level: Settled, starts: Settled, goals: int, bound: int
) -> Settled:
    """The newest level without the roots that have reached all their targets."""
    if starts.rows == 1 or starts.rows > bound:
        return level
    hits = [
        reached.df.where("hit").select("root")
        for reached, n in zip(search.levels, search.hits)
        if n
    ]
    per_root = reduce(DataFrame.unionByName, hits).groupBy("root").agg(F.count("*").alias("n"))
    done = per_root.where(F.col("n") == goals).select("root")
    left = level.df.join(F.broadcast(done), "root", "left_anti")
    return Settled(left, level.rows, None if level.head is None else left.collect())


#: Roots in a lane: the bits of a long.
LANE = 64


class Lanes:
    """Which roots have reached which nodes: ``(node, lane, bits)``, a bit per root.

    Roots are numbered; a lane holds ``LANE`` of them, so a node that all roots reach takes
    a row per lane, not per root.
    """

    def __init__(self, limits: Limits):
        self.limits, self.tables, self.rows = limits, [], 0

    def add(self, level: Settled) -> None:
        self.tables.append(level.df.select("node", "lane", "bits"))
        self.rows += level.rows
        if len(self.tables) > LEVELS_APART:
            self.tables = [cut(self._merged(reduce(DataFrame.unionByName, self.tables)))]

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("node", "lane").agg(F.bit_or("bits").alias("bits"))

    def unseen(self, arrivals: DataFrame) -> DataFrame:
        """``(node, lane, bits)`` of the arrivals that are new, each node and lane once."""
        arrivals = self._merged(arrivals)
        if not self.tables:
            return arrivals
        known = reduce(DataFrame.unionByName, self.tables)
        if self.rows <= self.limits.broadcast_rows:
            known = F.broadcast(self._merged(known).withColumnRenamed("bits", "known"))
            both = arrivals.join(known, ["node", "lane"], "left")
        else:  # one shuffle for both
            none = F.lit(0).cast("long")
            rows = arrivals.withColumn("known", none).unionByName(
                known.select("node", "lane", none.alias("bits"), F.col("bits").alias("known"))
            )
            both = rows.groupBy("node", "lane").agg(
                F.bit_or("bits").alias("bits"), F.bit_or("known").alias("known")
            )
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        return both.select("node", "lane", fresh.alias("bits")).where("bits <> 0")


def _numbered(roots: Settled) -> DataFrame:
    """``(root, lane, bit)``: roots by number, packed closely."""
    packed = cut(roots.df.select(F.col("node").alias("root")).coalesce(roots.rows // 1_000_000 + 1))
    number = F.monotonically_increasing_id()
    return packed.select(
        "root", F.shiftright(number, 6).alias("lane"), number.bitwiseAND(F.lit(LANE - 1)).cast("int").alias("bit")
    )


def _by_root(level: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(root, node)`` of every bit that is set."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(LANE - 1))).alias("bit")
    each = level.select("node", "lane", "bits", bit)
    each = each.where(F.expr("shiftrightunsigned(bits, bit) & 1L") == 1)
    return each.join(numbers, ["lane", "bit"]).select("root", "node")


@dataclass
class LaneSearch:
    """``(root, node)`` pairs found at each depth, and whether the hop bound ended the search."""

    pairs: list[tuple[int, DataFrame]] = field(default_factory=list)
    found: int = 0
    bound_hit: bool = False


def search_lanes(
    graph: PropertyGraph, roots: Settled, goals: Settled, max_hops: int | None = None
) -> LaneSearch:
    """Depths at which the goals are first reached from each root, all roots at once.

    ``roots`` and ``goals`` hold a ``node`` column of distinct nodes. A root that has reached
    all goals is taken out of the frontier.
    """
    with Dealt(graph) as dealt:
        return _search_lanes(graph, roots, goals, max_hops, dealt)


def _search_lanes(
    graph: PropertyGraph, roots: Settled, goals: Settled, max_hops: int | None, dealt: Dealt
) -> LaneSearch:
    bound = graph.limits.broadcast_rows
    numbers = _numbered(roots)
    numbers = F.broadcast(numbers) if roots.rows <= bound else numbers
    is_goal = goals.df.select("node", F.lit(True).alias("hit"))
    is_goal = F.broadcast(is_goal) if goals.rows <= bound else is_goal
    bits = F.expr("shiftleft(1L, bit)").alias("bits")
    frontier = settle(numbers.select(F.col("root").alias("node"), "lane", bits), graph.limits)
    seen, search, depth = Lanes(graph.limits), LaneSearch(), 0
    while frontier.rows and search.found < roots.rows * goals.rows:
        if max_hops is not None and depth >= max_hops:
            search.bound_hit = True
            break
        depth += 1
        arrivals = expand(dealt.before(frontier), frontier).select(F.col("dst").alias("node"), "lane", "bits")
        level = _existing(graph, seen.unseen(arrivals)).join(is_goal, "node", "left")
        level = settle(level.withColumn("hit", F.coalesce("hit", F.lit(False))), graph.limits)
        seen.add(level)
        if level.head is not None:
            hits = sum((row.bits & (2**LANE - 1)).bit_count() for row in level.head if row.hit)
        else:
            hits = level.df.where("hit").agg(F.sum(F.bit_count("bits"))).first()[0] or 0
        frontier = level
        if hits:
            search.pairs.append((depth, _by_root(level.df.where("hit"), numbers)))
            search.found += hits
            if 1 < roots.rows <= bound:
                frontier = _without_done(search, level, numbers, goals.rows)
    return search


def _without_done(search: LaneSearch, level: Settled, numbers: DataFrame, goals: int) -> Settled:
    """The newest level without the bits of roots that have reached all their goals."""
    pairs = reduce(DataFrame.unionByName, [df for _, df in search.pairs])
    done = pairs.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") == goals)
    done = done.join(numbers, "root").groupBy("lane").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("done"))
    left = level.df.join(F.broadcast(done), "lane", "left")
    open_ = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long"))))
    left = left.select("node", "lane", open_.alias("bits")).where("bits <> 0")
    return Settled(left, level.rows, None if level.head is None else left.collect())


def shortest_lengths(
    graph: PropertyGraph, sources: DataFrame, targets: DataFrame, max_hops: int | None = None
) -> DataFrame:
    """``(source, target, length)`` for every connected pair.

    Searched from whichever end has fewer nodes, all of them at once; what is kept grows with
    their number over ``LANE``. With ``max_hops`` a column ``bound_hit`` says whether pairs
    further apart may be missing.
    """
    ends = [
        settle(graph.existing(df.select("node").where("node is not null").distinct()), graph.limits)
        for df in (sources, targets)
    ]
    turned = ends[1].rows < ends[0].rows
    roots, goals = reversed(ends) if turned else ends
    search = search_lanes(graph.reversed() if turned else graph, roots, goals, max_hops)
    found = [
        pairs.select(
            F.col("node" if turned else "root").alias("source"),
            F.col("root" if turned else "node").alias("target"),
            F.lit(depth).cast("long").alias("length"),
        )
        for depth, pairs in search.pairs
    ]
    none = graph.nodes.sparkSession.createDataFrame([], "source long, target long, length long")
    result = reduce(DataFrame.unionByName, found) if found else none
    return result if max_hops is None else result.withColumn("bound_hit", F.lit(search.bound_hit))


def shortest_routes(
    graph: PropertyGraph, sources: DataFrame, targets: DataFrame, max_hops: int | None = None
) -> DataFrame:
    """``(source, target, step, node)`` for every connected pair."""
    search = search_many(graph, sources, targets, max_hops)
    return search.routes(graph.nodes.sparkSession, graph.limits.broadcast_rows)


def broken_steps(graph: PropertyGraph, routes: DataFrame) -> DataFrame:
    """Steps of ``(source, target, step, node)`` routes that are not edges of the graph.

    The edge table is reduced to the routes' own steps before the anti-join, so it
    is never shuffled whole.
    """
    steps = (
        routes.alias("here")
        .join(
            routes.select(
                "source", "target", (F.col("step") - 1).alias("step"), F.col("node").alias("dst")
            ),
            ["source", "target", "step"],
        )
        .select("source", "target", "step", F.col("node").alias("src"), "dst")
    )
    wanted = settle(steps, graph.limits)
    pairs = wanted.df.select("src", "dst").distinct()
    edges = graph.edges.select("src", "dst")
    sources = wanted.literals("src")
    if sources is not None:
        edges = edges.where(in_list("src", sources))
    if wanted.rows <= graph.limits.broadcast_rows:
        present = edges.join(F.broadcast(pairs), ["src", "dst"], "left_semi").distinct()
    else:
        present = edges.join(pairs, ["src", "dst"], "left_semi").distinct()
    return wanted.df.join(present, ["src", "dst"], "left_anti").select(
        "source", "target", "step", "src", "dst"
    )
