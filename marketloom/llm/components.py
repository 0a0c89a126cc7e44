"""Connected components of graphs too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.tables import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of every connected component of `edges` (a, b), by passing on least labels
    and following them, so that the number of rounds grows with the logarithm of a component's length."""
    e = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = e.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "node").hint("merge"), "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = cut_lineage(new.join(jump.hint("merge"), "next", "left").select("node", "label", F.least("next", "far").alias("next")))
        done = new.where(F.col("label") != F.col("next")).isEmpty()
        labels = new.select("node", F.col("next").alias("label"))
        if done:
            return labels
