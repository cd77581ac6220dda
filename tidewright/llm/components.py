"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import hot_join, shared, tidy


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node that it reaches.

    Each half round takes every node's smallest neighbour, a grouped minimum
    that combines before its shuffle, and joins it back to the links, those of
    a node with many of them in several parts. The
    links never grow, and the rounds are about the logarithm of the longest
    path. The first minimum of a round also tells whether all links are stars
    already: no node with a smaller neighbour then has another one. Minima and
    links are checkpoints, so that lineage stays short and a lost executor
    costs a round at most. Garbage of a finished round is collected before the
    next one, so that the driver need not hold the tasks, plans and shuffles of
    several rounds, which are many with many partitions.
    """
    links = shared(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        least = shared(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"), ((F.count_if(F.col("b") < F.col("a")) > 0) & (F.count(F.lit(1)) > 1)).alias("open")))
        if least.where("open").isEmpty():
            tidy(links.sparkSession)
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        large = hot_join(both, least.select("a", "m"), ["a"], ["b"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))  # the smallest neighbour's own link stays
        links = shared(hot_join(large, least, ["a"], ["b"]).select(ends.alias("a"), F.col("m").alias("b")).distinct())
        del both, large, least
        tidy(links.sparkSession)
    raise RuntimeError(f"components: no end after {rounds} rounds")
