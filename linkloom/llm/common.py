"""Shared helpers: table access, memory of Python tasks, and the scratch folder's."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkloom.scratch import bounded, materialise, scratch_path

__all__ = ["HELPER", "bounded", "files", "give_back", "lean", "materialise", "scratch_path", "table"]

#: Starts the names of columns that an operator adds beside those of its input.
HELPER = "__linkloom_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Rows that Python code holds as objects at once.
SLICE = 1024
#: The setting of Spark's batches, and its default: 10,000 documents in each of a task's buffers.
BATCH, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def give_back() -> None:
    """Return what a finished task held to the system: a worker outlives its tasks, and later ones run beside it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Run, rows: int | None = SLICE) -> Run:
    """``run`` (for ``mapInArrow``) on slices of at most ``rows`` rows, its memory given back at the task's end.

    A session that leaves Spark's batches at their default gets batches of ``SLICE`` rows.
    """
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get(BATCH, BATCH_DEFAULT) == BATCH_DEFAULT:
        session.conf.set(BATCH, str(SLICE))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                yield batch.slice(at, rows)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(sliced(batches))
        finally:
            give_back()

    return wrapped


#: Rows of a small table (ids, links) that one file holds.
FILE_ROWS = 1 << 19


def files(rows: int, each: int = FILE_ROWS) -> int:
    """Files (and tasks) for a table of at most ``rows`` rows, ``each`` in a file. ``coalesce`` never makes more than there are."""
    return max(1, -(-rows // each))
