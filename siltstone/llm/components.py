"""Distributed connected components.

Alternates two contractions until nothing changes.  *Large-star* links every larger
neighbour of a node to the least member of its neighbourhood; *small-star* does so for the
node and its smaller neighbours.  The edges end as stars around each component's least
node, after a number of rounds that grows with the logarithm of the graph's size.

Every step is an equi-join or an aggregate with map-side combining, so a hub's edges are
split by adaptive skew joins and never gathered.  Each round ends in a reliable
checkpoint; only one count and one checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = near.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    # edges point from the larger to the smaller node
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Columns ``node`` and ``component`` for the nodes of ``edges``.

    ``edges`` has two columns of one orderable type.  Direction, repeats, self-links and
    rows holding a null do not matter; a node that only links to itself is left out.
    ``component`` is the component's least node.  No edges give no rows.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(edges[a], edges[b]).alias("a"), F.least(edges[a], edges[b]).alias("b"), (edges[a].isNotNull() & edges[b].isNotNull()).alias("ok"))
    edges = cut(edges.where("ok and a <> b").select("a", "b").distinct())
    seen = _mark(edges)
    for _ in range(max_rounds if seen[0] else 0):
        edges = cut(_star(_star(edges, True), False), seen[0])
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
