"""Connected components of an edge table, by alternating large and small stars.

Each step replaces a node's edges by edges to the least node it knows.  Minima are
aggregated with map-side combining and joined back, so a hub's neighbours never meet in one
task, and each round is written to the shared folder.  Rounds go on until one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialise


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``edges`` (hi, lo) with hi > lo.  Small star: over lower neighbours; large star: over all."""
    if small:
        least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
        made = edges.join(least, "hi").select(
            F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")), F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo")))).alias("e")
        )
        made = made.select("e.hi", "e.lo")
    else:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        # Only larger neighbours move, so the edges are used as (u=lo, v=hi).
        made = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("least").alias("lo"))
    return made.where("hi > lo").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between different nodes; the component is its least node."""
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges = materialise(edges, "cc")
    state, before = _state(edges), None
    while state[0] and state != before:
        last, before = edges, state
        edges = materialise(_star(_star(edges, small=False), small=True), "cc")
        discard(last)
        state = _state(edges)
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _state(edges: DataFrame):
    """Edges, their nodes' sums by a hash: equal again only when a round changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
