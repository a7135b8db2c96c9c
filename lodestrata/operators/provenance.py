"""Containment: which container holds what, up and down the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containers_of(entries: DataFrame, leaves: DataFrame, leaf: str, container: str) -> DataFrame:
    """leaf, container of the wanted leaves; each pair once."""
    return entries.join(leaves.select(leaf).distinct(), leaf, "left_semi").select(leaf, container).distinct()


def blob_detail(entries: DataFrame, leaf: str, container: str) -> DataFrame:
    """leaf, number of containers, and the containers in order as one string."""
    per = entries.select(leaf, container).distinct().groupBy(leaf)
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.array_join(F.sort_array(F.collect_list(container)), ",").alias("containers"))


def walk(edges: DataFrame, roots: DataFrame, store) -> DataFrame:
    """root, node, depth: the least depth at which a node is reached; depth 0 is the root itself.

    edges(parent, child), roots(node). It ends when no new (root, node) appears, whatever the depth, the rows or the cycles.
    """
    reached = _reached(edges, roots.select(F.col("node").alias("root"), "node").distinct(), ["root"], store)
    return reached.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def reachable(edges: DataFrame, seeds: DataFrame, store) -> DataFrame:
    """node, depth: the least depth at which a node is reached from any seed."""
    return _reached(edges, seeds.select("node").distinct(), [], store)


def _reached(edges: DataFrame, start: DataFrame, carried: list[str], store) -> DataFrame:
    """The rows of start and all they lead to, with depth, by a frontier loop.

    Each round anti-joins what is already reached, so it ends when the frontier is empty, cycles included;
    store(df, name) writes a table in shared storage and reads it back, which cuts the lineage.
    """
    reached = store(start.withColumn("depth", F.lit(0)), "reached")
    frontier, depth = reached, 0
    while True:
        depth += 1
        new = frontier.join(edges, F.col("parent") == F.col("node")).select(*carried, F.col("child").alias("node")).distinct().join(reached, [*carried, "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = store(new, "frontier")
        if not frontier.limit(1).count():
            return reached
        reached = store(reached.unionByName(frontier), "reached")
