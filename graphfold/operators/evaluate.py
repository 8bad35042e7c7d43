"""How well two clusterings agree: contingency, Rand and adjusted Rand index, mutual and adjusted mutual information."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_cluster(items: DataFrame, item: str, cluster: str, order: list[str]) -> DataFrame:
    """(item, cluster): of an item that comes twice, the last in order."""
    return items.groupBy(F.col(item).alias("item")).agg(F.max_by(cluster, F.struct(*order)).alias("cluster"))


def id_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_shared, n_left, n_right): items of both, of the first only, of the second only."""
    both = a.select("item", F.lit(1).alias("l")).distinct().join(b.select("item", F.lit(1).alias("r")).distinct(), "item", "full_outer")
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    left, right = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.agg(count(left & right, "n_shared"), count(left & ~right, "n_left"), count(~left & right, "n_right"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ca, cb, n) over the items that both clusterings have."""
    return a.select("item", F.col("cluster").alias("ca")).join(b.select("item", F.col("cluster").alias("cb")), "item").groupBy("ca", "cb").agg(F.count("*").alias("n"))


def rand_scores(table: DataFrame) -> DataFrame:
    """(rand_index, adjusted_rand) of a contingency table; 1 for clusterings of fewer than two items."""
    two = lambda c: (c * (c - 1) / 2).cast("double")
    cells = table.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    rows = table.groupBy("ca").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    columns = table.groupBy("cb").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    one = cells.crossJoin(rows).crossJoin(columns).withColumn("t", two(F.col("total")))  # a row each
    expected, most = F.col("sa") * F.col("sb") / F.nullif("t", F.lit(0.0)), (F.col("sa") + F.col("sb")) / 2
    rand = (F.col("t") + 2 * F.col("s") - F.col("sa") - F.col("sb")) / F.nullif("t", F.lit(0.0))
    adjusted = (F.col("s") - expected) / F.nullif(most - expected, F.lit(0.0))
    return one.select(F.coalesce(rand, F.lit(1.0)).alias("rand_index"), F.coalesce(adjusted, F.lit(1.0)).alias("adjusted_rand"))


_SMALL = np.array([lgamma(v + 1) for v in range(1024)])


def log_factorial(v: np.ndarray) -> np.ndarray:
    """Of whole numbers: from a table, and by Stirling's series, which is exact to the last places from there on."""
    x = np.maximum(v, len(_SMALL) - 1).astype(np.float64)
    series = (x + 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(v < len(_SMALL), _SMALL[np.minimum(v, len(_SMALL) - 1).astype(np.int64)], series)


def expected_information(a: Column, b: Column, total: Column) -> Column:
    """The expected share of one cell in the mutual information of random clusterings with these margins.

    A cell's size is hypergeometric; sizes of 40 standard deviations and more from the mean weigh nothing,
    so that memory grows with the root of a cluster's size.
    """

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for i, j, t in zip(x, y, n, strict=True):
            mean = i * j / t
            reach = 40 * np.sqrt(mean * (1 - i / t) * (1 - j / t)) + 60
            cells = np.arange(max(1, i + j - t, int(mean - reach)), min(i, j, int(mean + reach)) + 1)
            fixed = sum(lgamma(v + 1) for v in (i, j, t - i, t - j)) - lgamma(t + 1)
            log_p = fixed - log_factorial(cells) - log_factorial(i - cells) - log_factorial(j - cells) - log_factorial(t - i - j + cells)
            out.append(float((cells / t * np.log(t * cells / (float(i) * j)) * np.exp(log_p)).sum()))
        return pd.Series(out)

    return share(a, b, total)


def information_scores(table: DataFrame) -> DataFrame:
    """(mutual_information, adjusted_mutual_information) in nats, normalised by the arithmetic mean of the entropies.

    Expected cells are worked out once for each pair of different margin sizes, times how often it comes.
    """
    total = table.agg(F.sum("n").alias("t"))
    rows, columns = (table.groupBy(c).agg(F.sum("n").alias(f"n_{c}")) for c in ("ca", "cb"))
    cells = table.join(rows, "ca").join(columns, "cb").crossJoin(F.broadcast(total))  # one row
    p = lambda c: F.col(c).cast("double") / F.col("t")
    information = cells.agg(F.sum(p("n") * F.log(F.col("t") * F.col("n").cast("double") / (F.col("n_ca") * F.col("n_cb")))).alias("mi"))
    entropy = lambda side, c, name: side.crossJoin(F.broadcast(total)).agg((-F.sum(p(c) * F.log(p(c)))).alias(name))
    sizes = [side.groupBy(F.col(c).alias(name)).agg(F.count("*").alias(f"k_{name}")) for side, c, name in ((rows, "n_ca", "x"), (columns, "n_cb", "y"))]
    margins = sizes[0].crossJoin(sizes[1]).crossJoin(F.broadcast(total))  # different sizes number at most the root of twice the items
    chance = margins.agg(F.sum(F.col("k_x") * F.col("k_y") * expected_information(F.col("x"), F.col("y"), F.col("t"))).alias("emi"))
    one = information.crossJoin(chance).crossJoin(entropy(rows, "n_ca", "ha")).crossJoin(entropy(columns, "n_cb", "hb"))
    adjusted = (F.col("mi") - F.col("emi")) / F.nullif((F.col("ha") + F.col("hb")) / 2 - F.col("emi"), F.lit(0.0))
    return one.select(F.col("mi").alias("mutual_information"), F.coalesce(adjusted, F.lit(1.0)).alias("adjusted_mutual_information"))


def map_ids(items: DataFrame, mapping: DataFrame, item: str, old: str = "old", new: str = "new", default: str | None = "error") -> DataFrame:
    """items with item replaced by what the mapping has for it, else by the default."""
    joined = items.join(mapping.select(F.col(old).alias(item), F.col(new).alias("gf_new")), item, "left")
    value = F.coalesce("gf_new", F.lit(default)) if default is not None else F.col("gf_new")
    return joined.select(*[value.alias(c) if c == item else F.col(c) for c in items.columns])
