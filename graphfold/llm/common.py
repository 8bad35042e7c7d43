"""What the operators share: joins with sets of ids, and how code reaches executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are runs of anything but these ASCII characters.
ASCII_SPACE = " \t\n\x0b\f\r"


#: Rows that go to Python at once at most, so that a worker holds a few MB of common texts.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, and keep what goes to Python small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_graphfold_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(prefix="graphfold-code-"), "graphfold_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in sorted((root / "graphfold").rglob("*.py")):
            bundle.write(path, path.relative_to(root).as_posix())
    context.addPyFile(target)
    context._graphfold_shipped = True


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """Apply a function of Arrow batches; make() is called once in each task and may keep state between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)

    return map_tasks(df, run, schema)


def map_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package at hand, after which a worker's memory is handed back but for its resident table."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return df.mapInArrow(task, schema)


def publish(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file along with the code, for executors that don't have the driver's folders."""
    spark.sparkContext.addFile(path)


def published(path: str) -> str:
    """Where a published file lies on this machine."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


_RESIDENT: dict = {}


def resident(key: tuple, make: Callable[[], object]):
    """What a worker process keeps between tasks: the last thing asked for only, as workers serve one operator after the other."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        hand_back()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def hand_back() -> None:
    """Give memory that is no longer in use back to the machine, which the allocators of a worker else keep until it ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text under names of their own, so that further columns of any name can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Ids that are sent to all executors at most, some 20 MB; more come by a shuffle.
BROADCAST_IDS = 500_000


def with_ids(df: DataFrame, id_col: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df whose id is in ids, or by left_anti is not; ids is a written table, without repeats."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    held = (F.broadcast(ids) if few else ids).select(F.col(f"`{id_col}`").alias("gf_held"))
    return df.join(held, F.col(f"`{id_col}`") == F.col("gf_held"), how)
