"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one grouped minimum and one join, so no task holds the neighbours of a node; the number of steps
grows with the logarithm of the size. Every step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b``: the smallest node that links lead to."""

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        """Link the neighbours of each node to the least of them: the larger ones, or the smaller ones and the node."""
        if large:
            pairs = pairs.union(pairs.select("b", "a").toDF("a", "b"))
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = pairs.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b"))
        return out.where(F.col("a") > F.col("b")).distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    downward = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b"))
    current = materialize(downward.distinct(), "edges")
    before = state(current)
    while before[0]:
        current = materialize(stars(stars(current, True), False), "edges")
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
