"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. large: every neighbour above a node goes to the least of its neighbourhood; small: the others below it do."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): for every node but the least of its component, that least node. edges: (a, b), in any order; loops and repeats do
    nothing. Rounds grow with the logarithm of the longest path, and each is checkpointed."""
    e = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        large = _star(e, True)
        new = checkpointed(_star(large, False))
        # at rest every node has one edge, and no target is itself moved on
        state = new.agg(F.count("*").alias("n"), F.count_distinct("a").alias("k")).first()
        if state["n"] == state["k"] and new.select("a").intersect(new.select(F.col("b").alias("a"))).isEmpty():
            return new
        e = new
