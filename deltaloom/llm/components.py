"""Connected components of a graph given as a table of edges, by alternating stars.

Each round joins every node to the least node around it, once upwards and once downwards; the number of rounds
grows with the logarithm of a component's size. Edges never leave the executors, and each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: all greater neighbours of a node go to the least node around it; small: all smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge; edges has the columns a and b."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        new = written(_stars(_stars(now, True), False), "edges")
        mark = tuple(new.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        now = new
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
