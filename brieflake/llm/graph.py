"""Connected components by alternating star contraction; every round is joins and minima, cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflake.llm.common import materialize


#: Edges up to which the minima of a round (two numbers a node) are broadcast.
BROADCAST_EDGES = 500_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every neighbour larger than a node is linked to the least of the node's neighbourhood."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(F.broadcast(least) if few else least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(F.broadcast(least) if few else least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (a long, b long). Returns (node, component) for every node of an edge that isn't its own component.

    component is the least node reachable. Stars hang on their least node; a hub's edges are never gathered, as
    each round only joins them with one minimum per node: those minima, at most two an edge, are broadcast up to
    BROADCAST_EDGES edges, so that no edge moves for it; beyond, Spark splits the skewed side of that join.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state, size = None, now.count()
    while True:
        few = size <= BROADCAST_EDGES
        after = materialize(_small_star(_large_star(now, few), few).filter("a <> b").distinct(), name)
        # an edge set that a round leaves as it is has only stars
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state, now, size = seen, after, seen[0]
