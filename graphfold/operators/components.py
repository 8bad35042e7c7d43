"""Connected components of links, by lowering labels along links and jumping over pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.plans.lineage import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the smallest node reachable.

    In each round the smaller label of a link's ends goes to the other end and to that end's root, and
    every node takes its label's label; the number of rounds grows with the logarithm of a component's
    diameter, and each but the last lowers a label. Nothing is collected. Without links the result is
    empty; a loop gives a component of one.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = cut(both.distinct(), "edges")
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v").where("lu < lv")
        offers = near.select(F.explode(F.array("v", "lv")).alias("node"), F.col("lu").alias("label")).groupBy("node").agg(F.min("label").alias("offer"))
        lowered = labels.join(offers, "node", "left").select("node", "label", F.least("label", "offer").alias("lower"))
        roots = lowered.select(F.col("node").alias("lower"), F.col("lower").alias("root"))
        jumped = lowered.join(roots, "lower", "left").select("node", F.coalesce("root", "lower").alias("new"), F.col("label").alias("old"))
        lower = cut(jumped.select("node", F.col("new").alias("label"), (F.col("new") != F.col("old")).alias("changed")), "labels")
        drop(labels)
        labels = lower
        if not labels.where("changed").limit(1).count():
            drop(edges)
            return labels.select("node", F.col("label").alias("component"))
