"""Graph, vector and measurement operators."""
