"""Connected components of a distributed edge list by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges(a, b): label is the least node of its component.

    Labels only fall, each round writes them to the shared folder, and it ends when none changes. Hubs
    are no bottleneck: minima are pre-aggregated before they shuffle, and joins on a hub can be split.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    last = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = stored(lower.join(jump, "label", "left").select("node", "old", F.least("label", "beyond").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        discard(last)
        labels, last = new.select("node", "label"), new
        if not changed:
            discard(both)
            return labels
