"""Cutting inputs into jobs of balanced size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balance(samples: DataFrame, least: int = 10, most: int = 2500, sample: str = "sample", cluster: str = "cluster", pool: str = "merged", recursive: bool = False) -> DataFrame:
    """samples with part: clusters below least are pooled, clusters above most are halved, the first half the larger.

    recursive cuts as often as most asks for instead of once. Places in a cluster follow the sample's order.
    """
    size = samples.groupBy(cluster).agg(F.count("*").alias("gf_n"))
    placed = samples.join(size, cluster).withColumn("gf_place", F.row_number().over(Window.partitionBy(cluster).orderBy(sample)))
    half = F.when(F.col("gf_place") <= F.ceil(F.col("gf_n") / 2), "a").otherwise("b")
    piece = F.concat(F.lit("_"), F.floor((F.col("gf_place") - 1) * F.ceil(F.col("gf_n") / most) / F.col("gf_n")).cast("string")) if recursive else half
    part = F.when(F.col("gf_n") < least, pool).when(F.col("gf_n") > most, F.concat(cluster, piece)).otherwise(F.col(cluster))
    return placed.withColumn("part", part).drop("gf_n", "gf_place")


def fixed_batches(rows: DataFrame, order: list[str], size: int = 50, digits: int = 4) -> DataFrame:
    """rows with batch, a zero-padded number: so many rows each, in order.

    Places come from counts before each range partition, so that no task holds all rows.
    """
    ranged = rows.repartitionByRange(*order).withColumn("gf_p", F.spark_partition_id())
    counts = ranged.groupBy("gf_p").agg(F.count("*").alias("n"))
    before = counts.select("gf_p", (F.sum("n").over(Window.orderBy("gf_p")) - F.col("n")).alias("gf_before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("gf_p").orderBy(*order))
    placed = ranged.withColumn("gf_place", within).join(F.broadcast(before), "gf_p")
    number = F.floor((F.col("gf_before") + F.col("gf_place") - 1) / size)
    return placed.withColumn("batch", F.lpad(number.cast("string"), digits, "0")).drop("gf_p", "gf_place", "gf_before")


def manifest(assignments: DataFrame, paths: DataFrame, sample: str = "sample", path: str = "path", order: Column | None = None) -> DataFrame:
    """assignments with the first path of their sample; those without one go."""
    known = paths.where(F.col(path).isNotNull() & (F.col(path) != ""))
    first = known.groupBy(sample).agg(F.min_by(path, order if order is not None else F.col(path)).alias(path))
    return assignments.join(first, sample)
