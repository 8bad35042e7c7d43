"""How well the surroundings of two nodes agree: the best identity between nodes near the one and near the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.operators.graph import ball
from graphfold.plans.lineage import cut

SHORT_CIRCUIT = 0.9


def symmetric(identities: DataFrame) -> DataFrame:
    """(x, y, ident) in both directions, of unordered pairs (x, y, ident)."""
    return identities.select("x", "y", "ident").unionByName(identities.select(F.col("y").alias("x"), F.col("x").alias("y"), "ident"))


def context_score(pairs: DataFrame, balls: DataFrame, identities: DataFrame) -> DataFrame:
    """(a, b, score): the highest identity between a member of a's ball and one of b's; 0 if there is none.

    The join goes through the identities, of which there are few, and so never forms the product of two
    balls. A node near both gives no support by itself.
    """
    of_a = balls.select(F.col("node").alias("a"), F.col("member").alias("x"))
    of_b = balls.select(F.col("node").alias("b"), F.col("member").alias("y"))
    support = pairs.select("a", "b").distinct().join(of_a, "a").join(symmetric(identities), "x").join(of_b, ["b", "y"])
    best = support.groupBy("a", "b").agg(F.max("ident").alias("gf_s"))
    return pairs.join(best, ["a", "b"], "left").withColumn("score", F.coalesce("gf_s", F.lit(0).cast(dict(identities.dtypes)["ident"]))).drop("gf_s")


def context_ladder(pairs: DataFrame, edges: DataFrame, identities: DataFrame, enough=SHORT_CIRCUIT, depths: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """pairs with s1, s2, s3: a deeper score is worked out only for pairs whose last one is below enough.

    Else it takes over the last one. Balls are formed about the nodes of the pairs that still need them.
    """
    scored, last = pairs, None
    for place, depth in enumerate(depths, 1):
        name = f"s{place}"
        if last is None:
            open_pairs, settled = scored, None
        else:
            open_pairs, settled = scored.where(F.col(last) < enough), scored.where(F.col(last) >= enough).withColumn(name, F.col(last))
        centres = open_pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        now = context_score(open_pairs, ball(edges, depth, centres), identities).withColumnRenamed("score", name)
        scored = cut(now if settled is None else now.unionByName(settled), "context")
        last = name
    return scored


def accepted(scored: DataFrame, family, context, keep_self_loops: bool = False) -> DataFrame:
    """Pairs that reach the family threshold and the context threshold at depth 1 and at 2 or 3.

    Without loops a deeper ball holds the shallower, so that the first two conditions imply the third.
    """
    first = scored.where((F.col("ident") >= family) & (F.col("s1") >= context))
    return first.where((F.col("s2") >= context) | (F.col("s3") >= context)) if keep_self_loops else first
