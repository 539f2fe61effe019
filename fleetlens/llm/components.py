"""Connected components of a graph given as edges between 64-bit nodes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties the smaller neighbours of a node, and the node, to the smallest of them. Edges point downwards."""
    least = edges.groupBy("a").agg(F.min("b").alias("root"))
    moved = edges.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node that ``edges`` (a, b) names.

    Alternates two star contractions, each an aggregation by node, until the edges no longer change; the number of
    rounds grows with the logarithm of the node count. No component is gathered anywhere. Loops (a = a) are taken
    as nodes; a null end drops the edge.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = edges.where("a = b")
    state, before = edges.where("a <> b"), None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        old, state = state, staged(_small_star(_large_star(state)), "edges")
        if hasattr(old, "staged_at"):
            discard(old)
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("root"))
    members = state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    return members.unionByName(alone.join(members.select("node"), "node", "left_anti"))
