"""Connected components of links between distinct nodes, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.shared import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` of every node in ``links`` (both columns bigint); label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so
    the rounds grow with the logarithm of the longest path in practice.  Labels only fall, and the loop
    ends when none changes, so the result is exact.  Partial minima are taken before each shuffle; a hub
    that a third of all links touch is one key of a join, which adaptive execution splits.
    """
    both = cut(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
        .union(links.select(F.col(b).alias("u"), F.col(a).alias("v")).where("u <> v")).distinct()
    )
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        )
        met = labels.join(near, F.col("node") == F.col("u")).select(
            "node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        after = cut(met.join(up, "label", "left").select(
            "node", "was", F.least("label", F.coalesce("top", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return labels
