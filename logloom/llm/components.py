"""Connected components of an undirected graph, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import written

#: Nodes of a graph whose minima are broadcast, some 12 MB; those of larger ones are dealt out.
BROADCAST_NODES = 1 << 18


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", node: str = "node", component: str = "component") -> DataFrame:
    """(node, component), a written table: each node of an edge with the smallest node reachable from it.

    Edges with a null end and loops are ignored; repeated edges are harmless; no edges, no rows.
    Each round is a groupBy with map-side minima and a join of nodes with their edges, by broadcast in
    small graphs, otherwise one that Spark splits where a node has very many; it is written out, and
    the round before deleted. Rounds grow with the logarithm of the graph's diameter.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    # Every edge points from the larger node to the smaller.
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not (state := _state(e)).stars:
        e = written(_round(e, state.nodes <= BROADCAST_NODES), "edges", (e,))
    named = e.select(F.col("u").alias(node), F.col("v").alias(component)).unionByName(e.select(F.col("v").alias(node), F.col("v").alias(component)).distinct())
    return written(named, "components", (e,))


def _round(e: DataFrame, small: bool) -> DataFrame:
    """The edges (u, v), u > v, after a large star and a small star. Of small graphs the minima are broadcast: three shuffles in place of ten."""
    dealt = F.broadcast if small else _dealt
    # Large star: the larger neighbours of u move to the smallest node around u.
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = dealt(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not small:
        large = large.distinct()  # else repeated edges cost less than a shuffle, and the last distinct() removes them
    # Small star: the smaller neighbours of u, and u, move to the smallest of them.
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(dealt(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> Row:
    """nodes: their number; stars: whether each either points to one other node, or is pointed to."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("pointed")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("pointed")))
    nodes = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("pointed").alias("pointed"))
    return nodes.agg(F.count("*").alias("nodes"), (F.count_if((F.col("points") > 1) | (F.col("points") * F.col("pointed") > 0)) == 0).alias("stars")).first()


def _dealt(low: DataFrame) -> DataFrame:
    """A row a node, dealt anew: a join right on its aggregate could not be split at a hub."""
    return low.hint("rebalance")
