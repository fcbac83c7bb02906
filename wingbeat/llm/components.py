"""Connected components of a link table, by rounds of joins: every node takes its smallest neighbour's label, then its label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """links (x, y) to (node, component): the smallest node reachable. Nodes without a link aren't listed.

    A label only falls; the rounds end when none does. Following labels doubles the reach of each round. With
    a number of rounds, nodes of equal label are connected, but connected nodes may still differ in label.
    """
    both = C.staged(links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).where("x <> y").distinct(), "links")
    labels = written = C.staged(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("component")), "labels")
    done = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        fell = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = fell.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = C.staged(fell.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        C.dropped(written)
        written, labels = new, new.select("node", "component")
        done += 1
        if done == rounds or new.where("was <> component").isEmpty():
            C.dropped(both)
            return labels
