"""Frontier expansion: reachable nodes by breadth, each level one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes of ``start`` (node) at depth 0 and what (a, b) edges lead to within ``depth`` steps.

    Each level joins only the new nodes and leaves out the visited ones; it is
    checkpointed, so a lost executor repeats one level.  Cycles end by
    themselves; null nodes are nowhere.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    seen = checkpoint(start.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        found = edges.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = checkpoint(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    return seen
