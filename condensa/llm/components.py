"""Connected components of an edge table, by distributed minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node of its component.

    Each round a node takes the least label of its neighbours (a map-side minimum, so a node with
    many edges is no single task's) and then its label's label; rounds grow with the logarithm
    of the longest path for the usual stars and chains of stars.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        nearer = cut(nearer)
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = cut(nearer.join(jump, "next", "left").select("node", "old", F.least("next", F.coalesce("far", "next")).alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            return labels
