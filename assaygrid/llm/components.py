"""Connected components of an edge table: the engine's star rounds.  Labels are the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import hung


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component of every node of the undirected edges (u, v) but the smallest of each component."""
    return hung(edges, most)
