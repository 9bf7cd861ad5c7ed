"""Connected components by alternating large-star and small-star steps over written tables.

A step is a grouped minimum and a join on the node, so a node with very many edges is summed before it is
shuffled and its join can be split.  Each round is written and read back: no round replans those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v): neighbours hang on the least node around them (large: only the greater ones)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    out = both.join(least, "u")
    if large:
        return out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    linked = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def hung(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of the undirected edges (u, v) but the smallest of each component."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = _state(now)
    for _ in range(most):
        if not before[0]:
            break
        last, now = now, written(star(star(now, True), False), "edges")
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of the undirected edges (u, v).

    Null ends and loops link nothing; no edges give an empty table.
    """
    rest = hung(edges.filter("u IS NOT NULL AND v IS NOT NULL"), most)
    return rest.unionAll(rest.select(F.col("component").alias("node"), "component").distinct())
