"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (the smallest node that links lead to) for every node of links (columns a and b).

    In each round a node takes the least label among its own and its neighbours', and then the label of that label, so
    labels travel twice as far each time. Minima are taken before the shuffle, so a node of many links is no burden.
    The labels are written out each round; the loop ends with the first round that changes none.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    both = scratch.keep(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component"))
    labels = scratch.keep(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        far = labels.select(F.col("node").alias("mid"), F.col("component").alias("jump"))
        step = hooked.join(far, "mid", "left").select("node", "old", F.least("mid", F.coalesce("jump", "mid")).alias("component"))
        step = scratch.keep(step, "labels")
        labels = step.select("node", "component")
        if step.where("component < old").isEmpty():
            return labels
