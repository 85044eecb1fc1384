"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """From columns a, b (long): node, root for each node that has an edge to another; root is the component's smallest node."""
    e = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # done when every edge leads to a node that leads nowhere, and no node leads to two
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x"))
        nested = e.select(F.col("b").alias("a")).distinct().join(low, "a", "left_semi").limit(1).count()
        if not nested and not low.filter("m != x").limit(1).count():
            break
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: the smaller neighbours of a node, and itself, go to the smallest of them
        large = stored(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = stored(small.distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
