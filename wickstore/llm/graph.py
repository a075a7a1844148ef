"""Connected components by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, kept_copy


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then follows labels one step further,
    so long chains halve. Labels are pre-aggregated per task, and each round's table is written to the
    shared folder. A link from a node to itself makes a component of one. Links with a null end are not
    links.
    """
    spark = links.sparkSession
    links = links.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    both = links.union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    both, both_path = kept_copy(both, "links")
    labels = both.groupBy("x").agg(F.least("x", F.min("y")).alias("label"))
    labels, path = kept_copy(labels, "labels")
    while True:
        near = (
            both.join(labels.select(F.col("x").alias("y"), "label"), "y")
            .groupBy("x")
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "x").select("x", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("x").alias("next"), F.col("label").alias("far"))
        moved = stepped.join(jump, "next").select(
            "x", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("new")
        )
        moved, next_path = kept_copy(moved, "labels")
        drop_copy(spark, path)
        labels, path = moved.drop("new"), next_path
        if moved.filter("new").isEmpty():
            drop_copy(spark, both_path)
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
