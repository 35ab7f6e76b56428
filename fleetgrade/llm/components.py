"""Connected components of a link table, as joins and aggregates.

Every round hooks each node to its neighbour (or itself) of lowest priority, where
priorities are hashes of the ids, and relabels the links by the hooks: links inside
a tree vanish, equal links merge. Priorities that are not sorted like the ids keep
trees flat, so chains shrink by a constant factor per round. Rounds are cut in the
shared checkpoint folder. A node with very many links is one row after map-side
aggregation; joins on it are split by AQE, as the other side has one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade.llm.common import cut


def _priority(column: str):
    return F.struct(F.xxhash64(column).alias("p"), F.col(column).alias("n"))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable. Nodes without links do not appear."""
    both = links.filter("a <> b").select("a", "b")
    edges = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while not edges.isEmpty():
        hooks = edges.groupBy("a").agg(F.min(_priority("b")).alias("m"))
        hooks = cut(hooks.select(F.col("a").alias("node"), F.when(F.col("m") < _priority("a"), F.col("m.n")).otherwise(F.col("a")).alias("root")))
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = cut(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = edges.join(left, "a").select("b", "x").join(right, "b").filter("x <> y")
        edges = cut(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).filter(F.lit(False))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
