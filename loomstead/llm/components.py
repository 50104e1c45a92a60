"""Connected components of a graph of links, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import materialise


def _star(edges: DataFrame) -> DataFrame:
    """From (node, near): each node's smallest neighbour or itself, beside each of its neighbours."""
    least = edges.groupBy("node").agg(F.min("near").alias("least")).withColumn("least", F.least("least", "node"))
    return edges.join(least, "node")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of links with the smallest node that it reaches.

    Links are pairs of numbers in either order, repeated or not; those with a null and those of a node with itself are left out, and so is a node
    without any other. Each step groups with partial aggregates and joins on nodes, which AQE splits where one node has many links. Steps are
    checkpointed, and repeat until the edges no longer change; their number follows the logarithm of the nodes.
    """
    pairs = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("near")).where("node <> near").distinct()
    edges, before = materialise(pairs), None
    while True:
        both = edges.select("node", "near").union(edges.select(F.col("near").alias("node"), F.col("node").alias("near")))
        large = _star(both).where("near > node and near <> least").select(F.col("near").alias("node"), F.col("least").alias("near")).distinct()
        starred = _star(large)
        small = (
            starred.where("near <> least").select(F.col("near").alias("node"), F.col("least").alias("near"))
            .union(starred.select("node", F.col("least").alias("near")))
            .where("node <> near").distinct()
        )
        edges = materialise(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "near").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("node", F.col("near").alias("component"))
        before = now
