"""Property-graph and vector analytics over plain node, edge and vector tables."""

from hopline.model import EDGE_SCHEMA, NODE_SCHEMA, PropertyGraph

__all__ = ["EDGE_SCHEMA", "NODE_SCHEMA", "PropertyGraph"]
