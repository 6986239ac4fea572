"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """(node, label): the smallest node of each linked node's component; links are (a, b) longs.

    Every round takes the smallest label among neighbours, then the label of one's label, and ends
    when nothing changes. Rounds are parquet tables, so a lost executor costs its tasks only.
    """
    both = scratch.write(f"{name}-edges", links.select(F.col("a").alias("node"), F.col("b").alias("other"))
                         .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    now = scratch.write(name, both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        near = both.join(now.select(F.col("node").alias("other"), F.col("label").alias("l")), "other") \
            .groupBy("node").agg(F.min("l").alias("near"))
        step = now.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        jump = now.select(F.col("node").alias("least"), F.col("label").alias("over"))
        step = step.join(jump, "least", "left").select(
            "node", F.least("least", F.coalesce("over", "least")).alias("new"), "label")
        step = scratch.write(f"{name}-step", step)
        done = step.where("new <> label").isEmpty()
        now = scratch.write(name, step.select("node", F.col("new").alias("label")))
        if done:
            scratch.drop(f"{name}-edges", f"{name}-step")
            return now
