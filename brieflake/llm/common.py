"""Shared helpers of the training-data operators: scratch tables, table reading, column checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or below the warehouse where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, row_group_bytes: int | None = None, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- in Python workers

#: Bytes of text that one step of a worker holds as Python objects.
SLICE_BYTES = 4 << 20

_held: dict[Any, Any] = {}


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def worker_model(key: Any, build: Callable[[], Any]) -> Any:
    """The model of that key, built once a worker process and kept for its later tasks; a worker holds one model at
    most: another key's is dropped first."""
    if key not in _held:
        _held.clear()
        give_back()
        _held[key] = build()
    return _held[key]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of `column`, at least a row each."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(size[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All batches by slices(); freed memory goes back after each and when they end."""
    for batch in batches:
        for part in slices(batch, column, most):
            yield part
            pa.default_memory_pool().release_unused()
    give_back()


# ---------------------------------------------------------------- joins

#: A key with more than this share (1 / HOT) of all rows is joined by broadcast: HOT such keys at most.
HOT = 2000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """left joined with right (written, one row a key), without a task for all rows of a frequent key.

    weight: column of right, how many rows of left have the key. Keys over 1 / HOT of all weights are at most HOT and
    are broadcast; the others are joined by shuffling, where no key holds more than that share. how: inner or left.
    """
    from pyspark.sql import functions as F

    total = right.agg(F.sum(F.col(weight).cast("double"))).first()[0] or 0.0
    hot, cold = right.filter(F.col(weight) * HOT > total), right.filter(F.col(weight) * HOT <= total)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))
