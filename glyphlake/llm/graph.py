"""Connected components of distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphlake.llm.common import discard, settle


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of undirected edges (a, b): the label is the least node that is reachable.

    Each round gives a node the least label of its neighbours and follows labels
    one step further, so that chains shorten as they are walked.  It ends when a round
    changes nothing.  Every round is settled; nothing but a flag reaches the driver.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", "m").alias("to"))
        onward = labels.select(F.col("node").alias("to"), F.col("label").alias("via"))
        step = step.join(onward, "to", "left").select("node", F.col("label").alias("old"), F.least("to", "via").alias("label"))
        new = settle(step, f"{name}-labels")
        discard(labels)
        if not new.where("old <> label").limit(1).count():
            discard(both)
            return new
        labels = new
