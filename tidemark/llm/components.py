"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """node, label (smallest node reachable) for every node of a link.

    Each round takes the smallest label of the neighbours (pre-aggregated per task) and
    then the label of the label, so rounds grow with the logarithm of the longest path.
    Labels are written to the shared folder each round."""
    both = store(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .where("u <> v")
        .distinct()
    )
    labels = store(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "v", "label": "l"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("l"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "l").alias("new"))
        jump = lower.select(F.col("node").alias("at"), F.col("new").alias("far"))
        after = store(
            lower.join(jump, lower["new"] == jump["at"]).select(
                "node", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved")
            )
        )
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels


def merged(labels: DataFrame | None, links: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """Labels (node, label) after further links. Each round works on the components so far,
    so links that are already joined are not gone through again."""
    if labels is None:
        return components(links, a, b)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    ends = links.select(F.col(a).alias("p"), F.col(b).alias("q")).join(of("p"), "p", "left").join(of("q"), "q", "left").select(
        "p", "q", F.coalesce("p_label", "p").alias("u"), F.coalesce("q_label", "q").alias("v"))
    ends = store(ends.distinct())
    if ends.isEmpty():
        return labels
    joined = components(ends, "u", "v").select(F.col("node").alias("label"), F.col("label").alias("new"))
    nodes = labels.unionByName(ends.select(F.col("p").alias("node"), F.col("u").alias("label"))).unionByName(ends.select(F.col("q").alias("node"), F.col("v").alias("label"))).distinct()
    return store(nodes.join(joined, "label", "left").select("node", F.coalesce("new", "label").alias("label")))
