"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockfit.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``<node, component>`` of every node in ``edges <a, b>``; the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows the pointers to their ends by
    doubling, and keeps the edges between what remains; chains and stars alike take few rounds.
    Nothing but counts reaches the driver. No edges give an empty table.
    """
    labels = None
    current = edges.select("a", "b").where(F.col("a") != F.col("b"))
    while True:
        both = current.union(current.select("b", "a"))
        parent = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")), "hook"
        )
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
            jumped = stored(parent.join(up, "parent").select("node", F.col("_above").alias("parent"), (F.col("_above") != F.col("parent")).alias("_moved")), "jump")
            moved = jumped.where("_moved").limit(1).count()
            parent = jumped.select("node", "parent")
            if not moved:
                break
        if labels is None:
            labels = parent.withColumnRenamed("parent", "component")
        else:
            up = parent.select(F.col("node").alias("component"), "parent")
            labels = labels.join(up, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
        ends = current
        for end in ("a", "b"):
            up = parent.select(F.col("node").alias(end), F.col("parent").alias(f"_{end}"))
            ends = ends.join(up, end)
        current = stored(
            ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where(F.col("a") != F.col("b")).distinct(),
            "edges",
        )
        if not current.limit(1).count():
            return stored(labels, "components")
