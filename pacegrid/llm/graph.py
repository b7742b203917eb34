"""Connected parts of a graph with hubs: no join meets all rows of a hub in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.tables import attach_group
from pacegrid.session import settle


def connected(ties: DataFrame) -> DataFrame:
    """``node, label`` for the undirected graph of ``a, b``: the smallest node of each connected part.

    Every node takes the least label among itself and its neighbours, then the label of that label,
    until nothing changes. A hub's edges, and the nodes that share a label, are dealt over several
    tasks. Each round is written to the shared folder. Loops are left out; no ties give no rows.
    """
    ties = ties.select("a", "b").where("a <> b")
    edges = settle(ties.union(ties.select("b", "a")).distinct())
    first = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    labels = settle(first.select(F.col("a").alias("node"), F.least("a", "m").alias("label"), "degree"))
    while True:
        around = attach_group(edges, labels.withColumnRenamed("node", "b"), "b", "degree", "a")
        least = around.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(least, "node").select("node", "degree", F.col("label").alias("old"), F.least("label", "m").alias("next"))
        step = settle(step)
        shared = step.groupBy("next").agg(F.count(F.lit(1)).alias("n"))
        far = shared.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next")
        jumped = attach_group(step, far, "next", "n", "node")
        jumped = settle(jumped.select("node", "degree", "old", F.least("next", "far").alias("label")))
        labels = jumped.select("node", "label", "degree")
        if jumped.where("label <> old").isEmpty():
            return labels.select("node", "label")
