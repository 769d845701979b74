"""Connected components of an edge table, as distributed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the smallest node that it is connected with.

    Large-star and small-star take turns: first every node ties its larger neighbours to the smallest of its
    neighbourhood, then each ties its smaller neighbours and itself to the smallest of them. Both keep what is connected and add no
    edges; after O(log^2 n) rounds, whatever the numbering, the edges are stars around the labels and no turn changes one.
    Each turn's edges are a table in the shared folder. Nothing is collected but a count.
    """
    nodes = edges.filter("a <> b")
    # From here on a > b.
    stars = settled(nodes.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    while True:
        ends = stars.select(F.col("b").alias("u"), F.col("b").alias("v")).union(stars.select("a", "b")).union(stars.select("b", "a"))
        least = ends.groupBy("u").agg(F.min("v").alias("least"))
        large = stars.join(least, F.col("b") == F.col("u")).select("a", F.col("least").alias("b"), (F.col("least") != F.col("b")).alias("moved"))
        large = settled(large.groupBy("a", "b").agg(F.max("moved").alias("moved")), "cc-large")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least"))
        tied = large.join(least, F.col("a") == F.col("u"))
        far = F.col("b") != F.col("least")
        tied = tied.select(F.when(far, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("least").alias("b"), (far | F.col("moved")).alias("moved"))
        fresh = settled(tied.groupBy("a", "b").agg(F.max("moved").alias("moved")), "cc-small")
        stars = fresh.select("a", "b")
        if fresh.filter("moved").limit(1).count() == 0:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(stars.select("b", "b").distinct())
