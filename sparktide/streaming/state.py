"""Keyed stream state: rows of a key in order, however many a micro-batch brings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from sparktide.operators.store import MICROS_PER_SLICE

#: Typed state needs a store that keeps several named states of a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Arrivals that one stretch of a spilled micro-batch covers.
ARRIVALS_PER_STRETCH = 50_000


def use_rocksdb(spark: SparkSession) -> None:
    """Let streams started from now on keep their state in RocksDB; another store that the session names stays."""
    named = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if not named or named.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


@contextmanager
def stream_workers(spark: SparkSession):
    """Let batch queries that run meanwhile use the Python workers of the streams.

    Spark keeps one set of workers for each setting they start with, and a set
    stays for a minute when idle.  Batch queries shorten tracebacks by default,
    keyed state does not, so an executor would hold two workers for each core.
    """
    name = "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stretch(samples: DataFrame) -> int:
    """Width of a stretch of ``seq`` that a task holds at once: arrivals, or six hours where ``seq`` is the time."""
    return MICROS_PER_SLICE if samples.schema["seq"].metadata.get("from_time") else ARRIVALS_PER_STRETCH


def _written(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


class InOrder(StatefulProcessor):
    """Gives the rows of a key, sorted, to :meth:`step`, which a subclass fills.

    Spark hands a key's micro-batch over in chunks of
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, in no order.  A single
    chunk is sorted and taken as it is.  More of them go through a map state,
    by stretches of the first order column, and come back stretch by stretch:
    a task never holds more than one chunk or one stretch of a key.
    """

    def __init__(self, order: list[str], width: int):
        self.order, self.width = order, width

    def init(self, handle) -> None:
        self.handle = handle
        self._waiting = handle.getMapState("waiting", "stretch long, part long", "rows binary")

    def begin(self, key, timers) -> None:
        """Load the state of a key."""

    def step(self, key, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Result of the next rows of the key, sorted."""
        raise NotImplementedError

    def end(self, key, timers) -> None:
        """Store the state of a key."""

    def control(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Take rows that are no samples out of a chunk, before any is stepped."""
        return rows

    def _sorted(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(self.order, kind="stable", ignore_index=True)

    def _stretches(self, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[int, int] = {}  # a count for each stretch is all that grows with the micro-batch
        for rows in chunks:
            rows = self.control(rows)
            for number, own in rows.groupby(rows[self.order[0]] // self.width):
                number = int(number)
                part = parts.get(number, 0)
                self._waiting.updateValue((number, part), (_written(own),))
                parts[number] = part + 1
        for number in sorted(parts):
            own = []
            for part in range(parts[number]):
                own.append(_read(bytes(self._waiting.getValue((number, part))[0])))
                self._waiting.removeKey((number, part))
            yield self._sorted(pd.concat(own) if len(own) > 1 else own[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.begin(key, timerValues)
        first, second = next(rows, None), next(rows, None)
        if second is not None:
            pieces = self._stretches(chain([first, second], rows))
        else:
            pieces = iter([] if first is None else [self._sorted(self.control(first))])
        for piece in pieces:
            if len(piece):
                out = self.step(key, piece)
                if out is not None and len(out):
                    yield out
        self.end(key, timerValues)

    def close(self) -> None:
        pass


def with_state(grouped, processor: StatefulProcessor, out: str, *, time_mode: str = "none", initial=None) -> DataFrame:
    """The rows a processor gives for the groups of a stream."""
    use_rocksdb(grouped._df.sparkSession)
    return grouped.transformWithStateInPandas(processor, T._parse_datatype_string(out), "Append", time_mode, initial)
