"""Connected components by Spark joins: no link and no component ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogfuse.llm.common import dropped, written


def components(edges: DataFrame, tables: str = "components") -> DataFrame:
    """(node, component): the smallest node that links lead to, for every node of ``edges`` (columns a, b).

    Each round gives a node the least label among those of its neighbours that changed in the round before, then the label of
    its label, so that paths halve; it ends when no label changed. A hub's labels are combined before the shuffle; where a hub's links meet its
    label, adaptive execution splits the hub.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), tables)
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumn("moved", F.lit(True)), tables)
    while True:
        # What a neighbour's label was before, its neighbours have seen already.
        moved = labels.where("moved").select(F.col("a").alias("b"), F.col("label").alias("near"))
        near = both.join(moved, "b").groupBy("a").agg(F.min("near").alias("near"))
        met = labels.join(near, "a", "left").select("a", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        of_label = labels.select(F.col("a").alias("new"), F.col("label").alias("further"))
        jumped = met.join(of_label, "new").select("a", F.least("new", "further").alias("label"), (F.least("new", "further") < F.col("label")).alias("moved"))
        jumped = written(jumped, tables)
        dropped(labels)
        labels = jumped
        if jumped.where("moved").isEmpty():
            dropped(both)
            return labels.select(F.col("a").alias("node"), F.col("label").alias("component"))
