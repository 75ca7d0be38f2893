"""What several operators of this package need: the shared folder, sizes of the work, Arrow batches as byte slices."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one slice of vectorised work holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 19


#: Rows and bytes of one batch between Spark and Python.  Whole texts are long: the default of 10,000 rows makes batches
#: of tens of megabytes, which both sides of every task hold.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session send texts in small batches; the rows of a result do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that a task has freed to the machine; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
    if trim:
        trim(0)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see.

    Only a local session (tests) may leave the setting unset; it then gets /tmp.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/sparktide"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column, in one pass over that column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long")).first()[0]


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least n, and at least 1."""
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) for runs of rows with at most limit bytes, or of one longer row.

    Offsets start at 0 and have one entry more than the run has rows; a null is an empty text.
    """
    first = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk) == 0:
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_string())
        _, where, data = chunk.buffers()
        ends = np.frombuffer(where, np.int64, len(chunk) + 1, chunk.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(chunk):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            stop = min(stop, len(chunk))
            yield first + row, ends[row : stop + 1] - ends[row], raw[ends[row] : ends[stop]]
            row = stop
        first += len(chunk)
