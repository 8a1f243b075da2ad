"""Connected components of a link table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b); the root is the smallest node of its component.

    Each round takes the least label among a node's neighbours and then the label of that label, so chains
    halve from round to round. Labels are written to the shared folder each round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.where(F.col("a") != F.col("b")).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        )
        lower = labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        upper = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = lower.join(upper, "root", "left").select("node", "old", F.least("root", "next").alias("root"))
        step = written(jumped)
        labels = step.select("node", "root")
        if step.where(F.col("old") != F.col("root")).isEmpty():
            return labels
