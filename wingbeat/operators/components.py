"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged


def components(links: DataFrame) -> DataFrame:
    """links (x, y) to (node, component): the smallest node that is reached. Nodes without a link aren't listed.

    In each round every node takes the smallest label next to it and then that label's own, so that the reach about
    doubles; labels only fall, and the rounds end when none does.
    """
    both = staged(links.where("x <> y").select("x", "y").union(links.where("x <> y").select("y", "x")).distinct(), "links")
    labels = staged(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        its = lower.select(F.col("node").alias("now"), F.col("now").alias("its"))
        labels = staged(lower.join(its, "now", "left").select("node", "was", F.least("now", F.coalesce("its", "now")).alias("component")), "labels")
        done = labels.where("was <> component").isEmpty()
        labels = labels.select("node", "component")
        if done:
            return labels
