"""Streaming anomaly scores and the periodic retraining job."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.functions.labels import labels_of
from sparktide.operators.anomaly import (
    DIFF_N, LAG_N, MODEL_COUNT, RETRAIN_INTERVAL_S, SCORE_THRESHOLD, SMOOTH_N, TRAINING_WINDOW_S, check_settings,
    feature_windows, train_models, values_needed,
)
from sparktide.streaming.state import InOrder, stream_workers, stretch, with_state

_MODEL = ["trained_us", "c0", "c1", "min_dist", "max_dist"]
_MODEL_DDL = "trained_us long, c0 array<double>, c1 array<double>, min_dist double, max_dist double"
_SCORED_DDL = "series_id string, name string, us long, value double, interval_s double, anomalous boolean, seq long"


def agreement(x: np.ndarray, model: tuple, threshold: float) -> np.ndarray:
    """Which vectors a model scores at the threshold or above."""
    _, c0, c1, low, high = model
    # added up in the order of the dimensions, as the batch form does
    reach = sum(np.sqrt(sum((x[:, i] - c[i]) ** 2 for i in range(x.shape[1]))) for c in (c0, c1)) / 2
    if low == high:
        return np.full(len(x), 0.0 >= threshold)
    return np.minimum(100.0, np.abs((reach - low) / (high - low)) * 100) >= threshold


class Scored(InOrder):
    """Flags samples by the vote of the models in force at their own time.

    State of a series: its last raw values, the newest time seen, and a list of
    models, those that a sample may still be judged by.
    """

    def __init__(self, width: int, model_count: int, shape: tuple[int, int, int], threshold: float, late_s: float):
        super().__init__(["seq", "us"], width)
        self.model_count, self.shape, self.threshold, self.late_us = model_count, shape, threshold, int(late_s * 1e6)

    def init(self, handle) -> None:
        super().init(handle)
        self.stored = handle.getValueState("held", "held array<double>, newest_us long")
        self.listed = handle.getListState("models", _MODEL_DDL)

    def _load(self) -> None:
        self.held, self.newest_us = self.stored.get() if self.stored.exists() else ([], np.iinfo(np.int64).min)
        self.models = sorted(tuple(m) for m in self.listed.get())
        self.changed = False

    def _add(self, rows: pd.DataFrame) -> None:
        new = [tuple(r) for r in rows[_MODEL].itertuples(index=False)]
        if new:
            known = {m[0] for m in self.models}
            more = [(int(t), list(a), list(b), float(low), float(high)) for t, a, b, low, high in new]
            self.models = sorted([*self.models, *({m[0]: m for m in more if m[0] not in known}.values())])
            self.changed = True

    def begin(self, key, timers) -> None:
        self._load()

    def control(self, rows: pd.DataFrame) -> pd.DataFrame:
        is_model = rows["trained_us"].notna()
        self._add(rows[is_model])
        return rows[~is_model]

    def step(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        held = np.array(self.held, dtype=float)
        values = np.concatenate([held, rows["value"].to_numpy(dtype=float)])
        need = values_needed(*self.shape)
        x = feature_windows(values, *self.shape)  # the last vectors end at the last values
        has = np.arange(len(held), len(values)) >= need - 1
        x = x[len(x) - np.count_nonzero(has) :]
        us = rows["us"].to_numpy(dtype=np.int64)
        flagged = np.zeros(len(rows), dtype=bool)
        upto = np.searchsorted(np.array([m[0] for m in self.models], dtype=np.int64), us, side="right")
        for end in np.unique(upto[has]):
            at = np.flatnonzero(has & (upto == end))
            ensemble = self.models[max(0, end - self.model_count) : end]
            vote = np.full(len(at), bool(ensemble))
            for model in ensemble:
                vote[vote] = agreement(x[at - (len(rows) - len(x))][vote], model, self.threshold)
            flagged[at] = vote
        self.held = values[-(need - 1) :].tolist()
        self.newest_us = max(self.newest_us, int(us.max()))
        return rows.assign(series_id=key[0], anomalous=flagged)[["series_id", "name", "us", "value", "interval_s", "anomalous", "seq"]]

    def end(self, key, timers) -> None:
        self.stored.update((self.held, self.newest_us))
        # a sample that is late_s behind is still judged by the models of its time
        passed = sum(m[0] <= self.newest_us - self.late_us for m in self.models)
        if passed > self.model_count:
            self.models, self.changed = self.models[passed - self.model_count :], True
        if self.changed:
            self.listed.put(self.models)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._load()
        self._add(initialState)
        self.listed.put(self.models)


def stream_score(
    samples: DataFrame,
    models: DataFrame,
    *,
    model_count: int = MODEL_COUNT,
    diff_n: int = DIFF_N,
    smooth_n: int = SMOOTH_N,
    lag_n: int = LAG_N,
    threshold: float = SCORE_THRESHOLD,
    late_s: float = RETRAIN_INTERVAL_S,
) -> DataFrame:
    """Samples with ``anomalous`` set by the vote of the models trained no later than their own time.

    ``models`` is a stream of the table that :func:`retrain` appends to, or a
    table, which is then the state that the query starts with.  A model counts
    for the samples of the micro-batch it comes with and later ones.  The state
    of a series holds the newest ``model_count`` models as of ``late_s`` before
    its newest sample, and those trained since, so that a late sample, too, is
    judged by the models of its time.
    """
    check_settings(model_count, diff_n=diff_n, smooth_n=smooth_n, lag_n=lag_n, score_threshold=threshold)
    known = models.select("series_id", F.unix_micros("trained_at").alias("trained_us"), *_MODEL[1:])
    rows = samples.select("series_id", "name", F.unix_micros("ts").alias("us"), "value", "interval_s", "seq")
    initial = None
    if models.isStreaming:
        rows = rows.unionByName(known, allowMissingColumns=True)
    else:
        initial = known.groupBy("series_id")
        rows = rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in zip(_MODEL, ("long", "array<double>", "array<double>", "double", "double"))))
    processor = Scored(stretch(samples), model_count, (diff_n, smooth_n, lag_n), threshold, late_s)
    scored = with_state(rows.groupBy("series_id"), processor, _SCORED_DDL, initial=initial)
    # rebuilding ts is also the projection a sort-merge join needs on top of Python state output
    return scored.withColumn("ts", F.timestamp_micros("us")).drop("us").withColumn("labels", labels_of(F.col("series_id")))


def retrain(points: DataFrame, models_path: str, now: datetime, *, window_s: int = TRAINING_WINDOW_S, **settings) -> None:
    """One scheduled training of every series at ``now``, appended to the model table.

    It runs on the Python workers of the streams that it feeds.
    """
    with stream_workers(points.sparkSession):
        train_models(points, train_at=[now], window_s=window_s, **settings).write.mode("append").parquet(models_path)
