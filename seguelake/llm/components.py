"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seguelake.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node reachable.

    Each round takes the smallest label among neighbours and then follows labels of
    labels, so a chain shrinks by more than half per round.  Rounds aggregate before
    they shuffle, and lineage is cut after each.  Links with nulls are ignored; no
    links give no rows.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = cut_lineage(links.union(links.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("lower"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        moved = step.join(up, step["lower"] == up["up"], "left").select(
            "node", F.least("lower", F.coalesce("top", "lower")).alias("new"), F.col("label").alias("old")
        )
        moved = cut_lineage(moved)
        changed = not moved.filter("new <> old").isEmpty()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
