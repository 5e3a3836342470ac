"""Connected components of an edge table, by label propagation with pointer jumping. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node, root for every node of an edge; root is the smallest node that can be reached."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        # the smallest label next to each node, then the label of that label
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("_near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "_near").alias("_low"))
        jump = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = step.join(jump, step["_low"] == jump["_n"], "left").select("node", F.least("_low", "_r").alias("root"), F.col("root").alias("_old"))
        new = staged(new, "labels")
        labels = new.select("node", "root")
        if new.where("root <> _old").isEmpty():
            return labels
