"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every neighbour that is larger than a node to the node's least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node (a) and its smaller neighbours (b) to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, longs), the root being
    the component's least node.

    Rounds of large star and small star, each on at most as many edges as before,
    until the edges are stars; a hub is never gathered in one task: its least
    neighbour is an aggregate, and joins on it can be split. All joins are sorted, so
    that none is broadcast by way of the driver. Nodes without an edge to another
    node don't appear; null and repeated edges count for nothing; an empty table
    gives an empty result.
    """
    clean = lambda e: e.where(F.col("a") != F.col("b")).distinct()
    edges = checkpointed(clean(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        mark = now
        edges = checkpointed(clean(_small_star(_large_star(edges))))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
