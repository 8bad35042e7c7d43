"""Cutting lineage between the steps of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphfold-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/graphfold-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.graphfold_path = path
    return kept


def drop(*frames: DataFrame) -> None:
    """Delete what cut() wrote for these, once nothing that is still to be computed reads it."""
    for frame in frames:
        spark = frame.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(frame.graphfold_path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
