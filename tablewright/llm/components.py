"""Connected components of a graph of edges (a, b), in rounds that grow with the logarithm of the nodes."""

from ..operators.graph import connected as components

__all__ = ["components"]
