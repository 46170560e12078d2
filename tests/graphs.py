"""Small graphs and a brute-force reference for them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from hopline.model import EDGE_SCHEMA, NODE_SCHEMA, PropertyGraph
from hopline.plans.limits import Limits

#: Bounds so low that small graphs take the routes meant for large ones.
TINY = Limits(
    literal_rows=1, broadcast_rows=2, hub_share=8, hub_rows=2, group_rows=3, query_rows=5
)


def graph_of(spark, nodes, edges, **kwargs):
    """``nodes``: ids or (id, category); ``edges``: (src, dst[, type[, ts]])."""
    node_rows = []
    for n in nodes:
        n_id, category = n if isinstance(n, tuple) else (n, "x")
        node_rows.append((n_id, category, float(n_id), 0))
    edge_rows = [(e + ("t", 0)[len(e) - 2 :])[:4] for e in edges]
    return PropertyGraph.of(
        spark.createDataFrame(node_rows, NODE_SCHEMA),
        spark.createDataFrame(edge_rows, EDGE_SCHEMA),
        **kwargs,
    )


def hub_edges(seed: int, nodes: int = 30, edges: int = 240):
    """Random edges; one source and one target hold a third each, one edge is copied a lot."""
    rng = random.Random(seed)
    out = []
    for i in range(edges):
        src, dst = rng.randrange(nodes), rng.randrange(nodes)
        if i % 3 == 0:
            src = 1
        elif i % 3 == 1:
            dst = 2
        out.append((src, dst, rng.choice("ab"), rng.randrange(100)))
    out += [(1, 2, "a", 7)] * 40
    return out


class Brute:
    """The same answers by plain loops over an edge list."""

    def __init__(self, edges):
        self.out = defaultdict(list)
        for src, dst, *_ in edges:
            self.out[src].append(dst)

    def walks(self, source, hops, simple=False):
        frontier = Counter({source: 1})
        for _ in range(hops):
            following = Counter()
            for node, n in frontier.items():
                for dst in set(self.out[node]) if simple else self.out[node]:
                    following[dst] += n
            frontier = following
        return frontier

    def distances(self, source):
        """Shortest distance of at least one edge."""
        found, frontier, depth = {}, [source], 0
        while frontier:
            depth += 1
            following = {d for n in frontier for d in self.out[n]} - set(found)
            found.update(dict.fromkeys(following, depth))
            frontier = list(following)
        return found

    def route(self, source, target):
        """The route with the smallest predecessor at every step back from the target."""
        far = self.distances(source)
        if target not in far:
            return None
        route, node, depth = [target], target, far[target]
        while depth > 0:
            depth -= 1
            level = [source] if depth == 0 else [n for n, d in far.items() if d == depth]
            node = min(n for n in level if node in self.out[n])
            route.insert(0, node)
        return route
