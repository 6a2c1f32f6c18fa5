"""Connected components of a table of links, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlog.session import materialized


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node of its component.

    Labels are lowered in rounds: every node, and the node it is labelled with, takes the smallest label next to it, then
    labels of labels are followed.  Rounds end when no label changes; their number grows with the logarithm of the
    longest path.  Links from a node to itself are allowed; an empty table gives no rows.
    """
    both = materialized(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialized(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lowered = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        lowered = materialized(lowered)
        offers = (
            lowered.select("node", "low")
            .union(lowered.filter("low < label").select(F.col("label").alias("node"), "low"))
            .groupBy("node").agg(F.min("low").alias("low"))
        )
        offers = materialized(offers)
        jump = offers.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        old = labels.select("node", "label")
        following = materialized(
            offers.join(jump, "low").join(old, "node").select("node", F.col("lower"), (F.col("lower") != F.col("label")).alias("moved"))
        )
        labels = following.select("node", F.col("lower").alias("label"))
        if following.filter("moved").isEmpty():
            return labels
