"""Connected components of an edge table by minimum labels and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.llm.shared import drop_table, stage_table


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: a long, b long.  Returns (id, component): every id of an edge with the smallest id it reaches.

    Each round takes the smallest label among a node and its neighbours, then the label of that label.  Labels are
    written every round; a single count of changes comes back to the driver.
    """
    both = stage_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage_table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.id == near.a, "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        up = labels.select(F.col("id").alias("up_id"), F.col("component").alias("up"))
        jumped = low.join(up, low.low == up.up_id, "left").select("id", F.col("component").alias("old"), F.least("low", F.coalesce("up", "low")).alias("component"))
        last, labels = labels, stage_table(jumped, "labels")
        drop_table(last)
        if labels.filter("old <> component").isEmpty():
            drop_table(both)
            return labels.select("id", "component")
