"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatloom.runtime import stage, unstage


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node that an edge (a, b) touches; root is the smallest id of its component.

    Every round is two pre-aggregated minima and two joins on the node, so a node with very many neighbours is split
    by the adaptive skew join and never gathered.
    """
    held = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = stage(large, "large-star")
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stage(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        unstage(held, large)
        held = small
        row = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return held.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(held.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
