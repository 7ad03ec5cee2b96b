"""What the operators of this folder share: reading tables, Arrow batches, the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from umbraframe.sources.state import importable, shared_dir, stored, stored_round, work_folder

#: Materialises a frame in the shared folder and cuts its lineage; lost executors don't matter afterwards.
cut = stored
#: The same for what the next round of a loop joins again.
cut_round = stored_round

__all__ = ["cut", "cut_round", "held", "load", "map_batches", "partitions_for", "record_batch", "release", "shared_dir", "texts_of", "unused", "work_folder"]

#: Rows and bytes that one Arrow batch holds at most; a batch is what a Python worker has in memory.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files and checkpoints that no frame needs any more. They go when the driver collects its garbage, which
    a loop of small steps would hardly ever make it do."""
    gc.collect()
    spark._jvm.System.gc()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store it can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by rows and by bytes, so that very long texts don't add up in a worker. Plans run after they
    are built, so the limits stay set for the session; they bound memory and change no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with bounded batches."""
    bounded_batches(df.sparkSession)
    importable(df.sparkSession)
    return df.mapInArrow(function, schema)


_held: dict = {}


def held(key, build: Callable):
    """What a Python worker keeps between tasks: one operator's tables or caches at a time, as workers are used again
    by every operator of an application."""
    if key not in _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)  # freed memory goes back to the system, where the C library can do that
        except (OSError, AttributeError):
            pass
        _held[key] = build()
    return _held[key]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null counts as an empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def record_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def unused(name: str, df: DataFrame) -> str:
    """The name, or a longer one that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
