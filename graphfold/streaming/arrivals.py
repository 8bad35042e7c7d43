"""Graphs that arrive as files: each micro-batch upserts what it brings into the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphfold.operators.store import Store

#: One row for each member of a node of an arriving graph.
SUPPORT = "graph_ord int, node_id string, member string, annotation string"


def deltas(batch: DataFrame) -> dict[str, DataFrame]:
    """The store's deltas of a batch of support rows."""
    nodes = batch.groupBy("node_id").agg(F.max("graph_ord").alias("last_iteration"), F.min_by("annotation", "graph_ord").alias("annotation"))
    empty = {c: F.lit(None) for c in ("size", "degrees", "genomeIDs", "maxLenId", "hasEnd", "description", "paralog", "mergedDNA")}
    return {"nodes": nodes.withColumns({"name": F.col("node_id"), **empty}), "node_members": batch.select("node_id", "member").distinct()}


def follow(spark: SparkSession, source: str, store: Store, checkpoint: str, make: Callable[[DataFrame], dict[str, DataFrame]] = deltas) -> StreamingQuery:
    """Upsert the Parquet files of a folder, each once; members are idempotent, so that a repeated batch does no harm."""
    arriving = spark.readStream.schema(SUPPORT).parquet(source)

    def step(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            store.apply(make(batch))

    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
