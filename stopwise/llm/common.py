"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.session import shared_folder


def pick(df: DataFrame, **wanted: Column | str) -> DataFrame:
    """Only the named input columns, under new names: ``pick(df, key="doc_id")``.

    Columns are found by their exact name, then regardless of case; of several
    of one name the first counts. Every operator starts with this, so further
    columns, also ones named like an operator's own, never clash.
    """
    names = df.columns
    lowered = [n.lower() for n in names]

    def place(name: str) -> int:
        if name in names:
            return names.index(name)
        if name.lower() in lowered:
            return lowered.index(name.lower())
        raise ValueError(f"no column {name!r} among {names}")

    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{place(old)}").alias(new) for new, old in wanted.items()])


_BATCH_SETTING, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a new shared folder and read back: the lineage ends here.

    Python tasks get their rows in batches of 8 MB while it is written, which both
    the JVM and the worker hold; the session's own setting comes back after.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, _BATCH_BYTES)
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(folder)


def worker_store(name: str) -> dict:
    """A dictionary that outlives the task: it stays with the Python worker until
    another operator asks for one, so a worker never holds those of several.

    Task code is sent by value, so its own globals would be new in every task.
    """
    holder = sys.modules.setdefault("_stopwise_llm_store", types.ModuleType("_stopwise_llm_store"))
    if getattr(holder, "owner", None) != name:
        holder.owner, holder.store = name, {}
        gc.collect()
        give_back()
    return holder.store


def give_back() -> None:
    """Return freed memory to the system, as a worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # the C library's own way
        trim(0)


def text_slices(batch: pa.RecordBatch, column: int, max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``max_bytes`` of text each, one row at least."""
    lengths = batch.column(column).nbytes
    if batch.num_rows <= 1 or lengths <= max_bytes:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from text_slices(batch.slice(0, half), column, max_bytes)
    yield from text_slices(batch.slice(half), column, max_bytes)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """The column as Python text, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def local_bytes(path: str) -> bytes:
    """A vocabulary file beside the driver; its content is sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
