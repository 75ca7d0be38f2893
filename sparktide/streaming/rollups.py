"""Streaming rollups and arrival-order dedup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.functions.labels import labels_of
from sparktide.operators.rollup import bucket_stats
from sparktide.streaming.state import InOrder, stretch, with_state


def stream_rollup(samples: DataFrame, width_s: int, delay: str) -> DataFrame:
    """Min, average and maximum per series and closed bucket.

    A bucket is written once the watermark (newest time seen minus ``delay``)
    has passed its end; later samples of that bucket are dropped, which the
    batch form counts.  ``delay`` has no default: it says how late a sample may be.
    """
    window = F.window("ts", f"{int(width_s)} seconds")
    stats = samples.withWatermark("ts", delay).groupBy("name", "series_id", window).agg(*bucket_stats())
    return stats.select(
        "name", labels_of(F.col("series_id")).alias("labels"), "series_id",
        F.col("window.start").alias("bucket"), "min", "avg", "max",
    )


_KEPT = ["series_id", "name", "us", "value", "interval_s", "anomalous", "seq", "sec"]
_KEPT_DDL = "series_id string, name string, us long, value double, interval_s double, anomalous boolean, seq long, sec long"


class Newest(InOrder):
    """Keeps samples whose second exceeds all before it; the state of a series is that second."""

    def __init__(self, width: int, forget_after_s: int | None):
        super().__init__(["seq", "us", "value"], width)
        self.forget_after_s = forget_after_s

    def init(self, handle) -> None:
        super().init(handle)
        self.stored = handle.getValueState("newest", "sec long, timer_ms long")

    def begin(self, key, timers) -> None:
        self.newest, self.timer_ms = self.stored.get() if self.stored.exists() else (np.iinfo(np.int64).min, None)

    def step(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        sec = rows["sec"].to_numpy()
        before = np.maximum.accumulate(np.concatenate([[self.newest], sec]))
        self.newest = int(before[-1])
        return rows[sec > before[:-1]][_KEPT]

    def end(self, key, timers) -> None:
        if self.forget_after_s is not None:
            timer_ms = (self.newest + self.forget_after_s) * 1000
            if timer_ms != self.timer_ms:
                if self.timer_ms is not None:
                    self.handle.deleteTimer(self.timer_ms)
                self.handle.registerTimer(timer_ms)
            self.timer_ms = timer_ms
        self.stored.update((self.newest, self.timer_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.stored.clear()
        return iter([])


def stream_dedup(samples: DataFrame, forget_after_s: int | None = None, delay: str | None = None) -> DataFrame:
    """Per series, only samples whose second exceeds every earlier one.

    State per series is one number in the state store.  With ``forget_after_s``
    a series leaves it once the watermark, the newest time of all series minus
    ``delay``, is so many seconds past its last sample; samples later than
    ``delay`` are dropped then.  Within a micro-batch arrival order is ``seq``.
    Labels are rebuilt from the series id.
    """
    timed = forget_after_s is not None
    if timed and delay is None:
        raise ValueError("forgetting needs a delay")
    if timed:
        samples = samples.withWatermark("ts", delay)
    rows = samples.withColumn("us", F.unix_micros("ts")).select(*_KEPT, *(["ts"] if timed else []))
    kept = with_state(rows.groupBy("series_id"), Newest(stretch(samples), forget_after_s), _KEPT_DDL, time_mode="eventTime" if timed else "none")
    # rebuilding ts is also the projection a sort-merge join needs on top of Python state output
    return kept.withColumn("ts", F.timestamp_micros("us")).drop("us").withColumn("labels", labels_of(F.col("series_id")))
