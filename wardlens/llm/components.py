"""Connected components of a table of links, by minimum labels and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.tables import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for the nodes of ``a, b`` links.

    Each round gives every node the smallest label among its neighbours and itself, then the
    label of that label; both are grouped minima, so a node with many links is reduced in the
    map tasks. Tables are written between rounds; only a flag reaches the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "links")
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(
            F.col("a").alias("node"), "component"
        )
        low = near.union(labels.select("node", "component")).groupBy("node").agg(F.min("component").alias("component"))
        low = materialize(low, "labels")
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = low.join(jump, "component").select("node", F.col("next").alias("component"))
        new = materialize(jumped, "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old")
        if changed.isEmpty():
            return new
        labels = new
