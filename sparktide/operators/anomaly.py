"""Per-series anomaly detection with ensembles of two-centroid models."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktide.functions.labels import labels_of
from sparktide.functions.numbers import anomaly_score, mean_distance
from sparktide.functions.times import floor_to, unix_second
from sparktide.operators.select import time_range
from sparktide.plans.slices import SLICE_SECONDS, last_of, slice_window, tails, with_rows_before, with_slice

# Defaults of the detector.
MODEL_COUNT = 18
TRAINING_WINDOW_S = 6 * 3600
RETRAIN_INTERVAL_S = 3 * 3600
DIFF_N = 1
SMOOTH_N = 3
LAG_N = 5
SCORE_THRESHOLD = 99.0
MAX_ROUNDS = 500
RANKING_WINDOW_S = 600

#: Windows whose training times share a group.
BLOCK_WINDOWS = 4

#: Vectors whose distances are taken at once, so that the fit holds one copy of a window's vectors.
FIT_VECTORS = 65_536

MODEL_DDL = (
    "series_id string, trained_at timestamp, c0 array<double>, c1 array<double>, min_dist double, max_dist double"
)


def check_settings(
    model_count: int = MODEL_COUNT,
    training_window_s: float = TRAINING_WINDOW_S,
    retrain_interval_s: float = RETRAIN_INTERVAL_S,
    diff_n: int = DIFF_N,
    smooth_n: int = SMOOTH_N,
    lag_n: int = LAG_N,
    score_threshold: float = SCORE_THRESHOLD,
) -> None:
    """ValueError naming every setting out of its bounds."""
    bad = [
        text for wrong, text in (
            (model_count < 1, "model_count must be at least 1"),
            (training_window_s <= 0, "training_window must be positive"),
            (retrain_interval_s <= 0, "retrain_interval must be positive"),
            (diff_n not in (0, 1), "diff_n must be 0 or 1"),
            (smooth_n < 0, "smooth_n must not be negative"),
            (lag_n < 1, "lag_n must be at least 1"),
            (not 0 < score_threshold <= 100, "score_threshold must be in (0,100]"),
        ) if wrong
    ]
    if bad:
        raise ValueError("; ".join(bad))


def values_needed(diff_n: int = DIFF_N, smooth_n: int = SMOOTH_N, lag_n: int = LAG_N) -> int:
    """Raw values one feature vector spans."""
    return diff_n + max(smooth_n, 1) + lag_n


def feature_vectors(
    points: DataFrame,
    diff_n: int = DIFF_N,
    smooth_n: int = SMOOTH_N,
    lag_n: int = LAG_N,
    *,
    order: Sequence[str] = ("ts",),
    slice_s: int = SLICE_SECONDS,
    keep_all: bool = False,
) -> DataFrame:
    """Difference, rolling mean and lags of each series as an array ``x``.

    ``x`` runs from the oldest to the current smoothed value.  Points without
    enough history get no row, or a null ``x`` with ``keep_all``.
    """
    order = list(order)
    rows = with_rows_before(points, ["series_id"], order, ["value"], values_needed(diff_n, smooth_n, lag_n) - 1, slice_s)
    rows = _with_vectors(rows, order, diff_n, smooth_n, lag_n)
    keep = ~F.col("is_context") if keep_all else ~F.col("is_context") & F.col("x").isNotNull()
    return rows.where(keep).drop("is_context")


def _with_vectors(rows: DataFrame, order: Sequence[str], diff_n: int, smooth_n: int, lag_n: int) -> DataFrame:
    """Rows of slices, with those before each, and the vector that ends at each row; null where there is none."""
    w = slice_window(["series_id"], order)
    step = F.col("value") - F.lag("value", diff_n).over(w) if diff_n > 0 else F.col("value")
    rows = rows.withColumn("_d", step)
    if smooth_n > 1:
        frame = w.rowsBetween(-(smooth_n - 1), 0)
        full = F.count("_d").over(frame) == smooth_n
        rows = rows.withColumn("_m", F.when(full, F.avg("_d").over(frame)))
    else:
        rows = rows.withColumn("_m", F.col("_d"))
    lags = [F.lag("_m", i).over(w) if i else F.col("_m") for i in range(lag_n, -1, -1)]
    # lags within a run are full exactly when the oldest one is
    rows = rows.withColumn("_oldest", lags[0]).withColumn("x", F.when(F.col("_oldest").isNotNull(), F.array(*lags)))
    return rows.drop("_d", "_m", "_oldest")


def feature_windows(values: np.ndarray, diff_n: int, smooth_n: int, lag_n: int) -> np.ndarray:
    """Feature vectors of one training window, all within that window."""
    series = values[diff_n:] - values[: len(values) - diff_n] if diff_n > 0 else values
    if smooth_n > 1:
        if len(series) < smooth_n:
            return np.empty((0, lag_n + 1))
        series = np.lib.stride_tricks.sliding_window_view(series, smooth_n).mean(axis=1)
    if len(series) < lag_n + 1:
        return np.empty((0, lag_n + 1))
    return np.lib.stride_tricks.sliding_window_view(series, lag_n + 1)


def _nearer_second(dims: np.ndarray, centres: list[np.ndarray], scale: float) -> np.ndarray:
    """Which vectors are nearer to the second centroid, by the side of the bisecting plane they are on.

    Vectors too near to the plane for that are compared by their distances.
    """
    way = centres[1] - centres[0]
    beyond = way @ dims - way @ (centres[0] + centres[1]) / 2
    far = beyond > 0
    close = np.flatnonzero(np.abs(beyond) <= 1e-9 * scale * (np.abs(way).sum() + scale))
    if len(close):
        gaps = [np.sqrt(((dims[:, close] - c[:, None]) ** 2).sum(axis=0)) for c in centres]
        far[close] = gaps[0] > gaps[1]
    return far


def _fit(vectors: np.ndarray, max_rounds: int, early_stop: bool):
    """Two centroids: seeded by the first vector and the first one farthest from it.

    A tie in distance goes to the first centroid, an empty cluster keeps its
    centroid.  Once no vector changes sides further rounds change nothing, so
    stopping there equals running them all.
    """
    # one contiguous row per dimension keeps every step a few long vector operations
    dims = np.ascontiguousarray(vectors.T, dtype=float)

    def reach(centre: np.ndarray) -> np.ndarray:
        out = np.empty(dims.shape[1])
        for at in range(0, len(out), FIT_VECTORS):
            gap = dims[:, at : at + FIT_VECTORS] - centre[:, None]
            out[at : at + FIT_VECTORS] = np.sqrt(np.multiply(gap, gap, out=gap).sum(axis=0))
        return out

    centres = [dims[:, 0].copy(), None]
    centres[1] = dims[:, int(np.argmax(reach(centres[0])))].copy()
    sides = None
    scale = float(max(dims.max(initial=0.0), -dims.min(initial=0.0)))
    for _ in range(max_rounds):
        far = _nearer_second(dims, centres, scale)
        if early_stop and sides is not None and np.array_equal(far, sides):
            break
        sides = far
        for side, members in enumerate((~far, far)):
            count = np.count_nonzero(members)
            if count:
                centres[side] = dims @ members.astype(float) / count
    mean_reach = (reach(centres[0]) + reach(centres[1])) / 2
    return centres[0], centres[1], float(mean_reach.min()), float(mean_reach.max())


def train_models(
    points: DataFrame,
    *,
    train_at: Sequence[datetime] | None = None,
    every_s: int = RETRAIN_INTERVAL_S,
    start: datetime | None = None,
    end: datetime | None = None,
    window_s: int = TRAINING_WINDOW_S,
    diff_n: int = DIFF_N,
    smooth_n: int = SMOOTH_N,
    lag_n: int = LAG_N,
    max_rounds: int = MAX_ROUNDS,
    early_stop: bool = True,
) -> DataFrame:
    """One model per series and training time, from the points in ``[t - window, t]``.

    Training times are either listed or the multiples of ``every_s`` within
    ``[start, end]``.  A group is one series and a stretch of training times: a
    listed one, or those of ``BLOCK_WINDOWS`` windows of a grid.  The points of
    overlapping windows travel once, and each window is a part of the sorted
    group.  On stored points (one per second) a group has at most
    ``(BLOCK_WINDOWS + 1) * window_s`` rows and those of one interval, so none grows with the table.
    Series with fewer than two vectors get no model.
    """
    check_settings(1, window_s, every_s, diff_n, smooth_n, lag_n)
    sec, us = unix_second("ts"), F.unix_micros("ts")
    if train_at is not None:
        listed = sorted({int(round(t.timestamp() * 1e6)) for t in train_at})
        near = F.array(*[F.when((us <= t) & (us >= t - window_s * 1_000_000), F.lit(t)) for t in listed]) if listed else F.array().cast("array<bigint>")
        blocks, grid = F.filter(near, lambda t: t.isNotNull()), None
        first, final = min(train_at, default=None), max(train_at, default=None)
    else:
        if start is None or end is None:
            raise ValueError("give train_at, or start and end")
        first, final = start, end
        grid = (-(-start.timestamp() // every_s) * every_s, end.timestamp())
        width = every_s * max(1, round(BLOCK_WINDOWS * window_s / every_s))
        # the first and the last training time that a point counts for
        up = floor_to(F.greatest(-F.floor(-us / 1e6), F.lit(int(grid[0]))) + (every_s - 1), every_s)
        until = floor_to(F.least(sec + window_s, F.lit(math.floor(grid[1]))), every_s)
        span = F.sequence(floor_to(up, width), floor_to(until, width), F.lit(width).cast("long"))
        blocks = F.when(up <= until, F.transform(span, lambda t: t * 1_000_000)).otherwise(F.array().cast("array<bigint>"))
    if first is not None:
        # bounds on time and day reach the scan of a stored table
        points = time_range(points, first - timedelta(seconds=window_s), final)
    sent = points.select("series_id", F.explode(blocks).alias("_block"), us.alias("_us"), "value")

    def times(block: int) -> list[int]:
        if grid is None:
            return [block]
        return [int(t) * 1_000_000 for t in range(max(block // 1_000_000, int(grid[0])), block // 1_000_000 + width, every_s) if t <= grid[1]]

    def train(table: pa.Table) -> pa.Table:
        order = np.argsort(table["_us"].to_numpy(), kind="stable")
        at, values = table["_us"].to_numpy()[order], table["value"].to_numpy()[order].astype(float)
        found = []
        for t in times(table["_block"][0].as_py()):
            window = slice(np.searchsorted(at, t - window_s * 1_000_000, "left"), np.searchsorted(at, t, "right"))
            vectors = feature_windows(values[window], diff_n, smooth_n, lag_n)
            if len(vectors) >= 2:
                found.append((t, *_fit(vectors, max_rounds, early_stop)))
        return pa.table({
            "series_id": pa.array([table["series_id"][0].as_py()] * len(found), pa.string()),
            "trained_at": pa.array([f[0] for f in found], pa.int64()).cast(pa.timestamp("us", tz="UTC")),
            "c0": pa.array([f[1].tolist() for f in found], pa.list_(pa.float64())),
            "c1": pa.array([f[2].tolist() for f in found], pa.list_(pa.float64())),
            "min_dist": pa.array([f[3] for f in found], pa.float64()),
            "max_dist": pa.array([f[4] for f in found], pa.float64()),
        })

    return sent.groupBy("series_id", "_block").applyInArrow(train, MODEL_DDL)


def newest_models(models: DataFrame, model_count: int = MODEL_COUNT) -> DataFrame:
    """The models each series' ensemble holds now."""
    newest = Window.partitionBy("series_id").orderBy(F.col("trained_at").desc())
    return models.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= model_count).drop("_rank")


def ensembles(models: DataFrame, model_count: int = MODEL_COUNT) -> DataFrame:
    """Per series and training time, the (at most ``model_count``) models in force from then on."""
    recent = Window.partitionBy("series_id").orderBy("trained_at").rowsBetween(-(model_count - 1), 0)
    model = F.struct("c0", "c1", "min_dist", "max_dist")
    return models.select("series_id", F.col("trained_at").alias("since"), F.collect_list(model).over(recent).alias("models"))


def _before_slices(points: DataFrame, models: DataFrame, k: int, order: list[str], model_count: int, slice_s: int) -> DataFrame:
    """What each slice needs from before it, as rows of that slice.

    One row without a time carries ``epochs``: the ensemble in force when the
    slice starts and those that begin in it, with their times.  The others are
    the last ``k`` values before the slice.  The tails of the slices and the
    models meet in one shuffle by series, which serves all windows here; both
    are small beside the points.
    """
    tail = tails(with_slice(points, slice_s), ["series_id"], order, ["value"], k).select("series_id", "slice", "tail")
    model = models.select(
        "series_id", floor_to(unix_second("trained_at"), slice_s).alias("slice"), F.unix_micros("trained_at").alias("_us"),
        F.struct("c0", "c1", "min_dist", "max_dist").alias("_model"),
    )
    is_model = F.col("_us").isNotNull()
    recent = Window.partitionBy("series_id", is_model).orderBy("_us").rowsBetween(-(model_count - 1), 0)
    marks = tail.unionByName(model, allowMissingColumns=True).repartition("series_id")
    begin = F.when(is_model, F.struct(F.col("_us").alias("us"), F.collect_list("_model").over(recent).alias("models")))
    slices = marks.withColumn("_begin", begin).groupBy("series_id", "slice").agg(
        F.first("tail", ignorenulls=True).alias("tail"), F.sort_array(F.collect_list("_begin")).alias("_begun")
    )
    # any slice with points holds at least one, so k earlier ones suffice
    earlier = Window.partitionBy("series_id", F.col("tail").isNotNull()).orderBy("slice").rowsBetween(-k, -1)
    so_far = Window.partitionBy("series_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.try_element_at("_begun", F.lit(-1))["models"], ignorenulls=True).over(so_far)
    start = F.when(F.col("_last").isNotNull(), F.array(F.struct((F.col("slice") * 1_000_000).alias("us"), F.col("_last").alias("models"))))
    known = (
        slices.withColumn("_before", F.flatten(F.collect_list("tail").over(earlier))).withColumn("_last", last)
        .where(F.col("tail").isNotNull())
        .select("series_id", "slice", last_of(F.col("_before"), k).alias("_before"), F.concat(F.coalesce(start, F.slice("_begun", 1, 0)), "_begun").alias("epochs"))
    )
    fields = list(dict.fromkeys([*order, "value"]))
    rows = known.select("series_id", "slice", "epochs", F.posexplode_outer("_before").alias("_at", "_row"))
    values = rows.select("series_id", "slice", *[F.col(f"_row.{c}").alias(c) for c in fields], F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("epochs")).alias("epochs"))
    return values.withColumn("is_context", F.lit(True))


def score_samples(
    points: DataFrame,
    models: DataFrame,
    *,
    model_count: int = MODEL_COUNT,
    diff_n: int = DIFF_N,
    smooth_n: int = SMOOTH_N,
    lag_n: int = LAG_N,
    threshold: float = SCORE_THRESHOLD,
    order: Sequence[str] = ("ts",),
    slice_s: int = SLICE_SECONDS,
) -> DataFrame:
    """Set ``anomalous`` where every model in force scores at or above ``threshold``.

    A point is judged by the newest ``model_count`` models trained no later than
    its own time; without a model or enough history it is normal.  Points are
    read twice, for the ends of their slices and as they are, and models once;
    all that a slice needs comes with its rows in one shuffle.  The vote stops
    at the first model that disagrees.
    """
    check_settings(model_count, TRAINING_WINDOW_S, RETRAIN_INTERVAL_S, diff_n, smooth_n, lag_n, threshold)
    order = list(order)
    before = _before_slices(points, models, values_needed(diff_n, smooth_n, lag_n) - 1, order, model_count, slice_s)
    rows = with_slice(points, slice_s).withColumn("is_context", F.lit(False)).unionByName(before, allowMissingColumns=True)
    rows = _with_vectors(rows, order, diff_n, smooth_n, lag_n)
    whole = slice_window(["series_id"], order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    now = F.unix_micros("ts")
    dims = lag_n + 1

    def agrees(m):
        distance = mean_distance(F.col("x"), m["c0"], m["c1"], dims)
        return anomaly_score(distance, m["min_dist"], m["max_dist"]) >= threshold

    begun = F.filter(F.first("epochs", ignorenulls=True).over(whole), lambda e: e["us"] <= now)
    vote = F.col("x").isNotNull() & (F.size("_models") > 0) & F.forall("_models", agrees)
    return (
        rows.withColumn("_models", F.try_element_at(begun, F.lit(-1))["models"])
        .where(~F.col("is_context"))
        .withColumn("anomalous", F.coalesce(vote, F.lit(False)))
        .select(*points.columns, *([] if "anomalous" in points.columns else ["anomalous"]))
    )


def anomaly_ranking(points: DataFrame, now=None, window_s: float = RANKING_WINDOW_S) -> DataFrame:
    """Share of flagged points per series over the window, highest first.

    Series without a flagged point do not appear; equal rates sort by series.
    """
    if window_s <= 0:
        raise ValueError("window must be positive")
    if now is not None:
        until = F.lit(now).cast("timestamp")
        points = points.where(
            F.col("ts").between(F.timestamp_micros(F.unix_micros(until) - int(window_s * 1_000_000)), until)
        )
    counted = points.groupBy("name", "series_id").agg(
        F.count_if("anomalous").alias("_flagged"), F.count(F.lit(1)).alias("count")
    )
    ranked = counted.where(F.col("_flagged") > 0).select(
        "name", labels_of(F.col("series_id")).alias("labels"), "series_id",
        (F.col("_flagged") / F.col("count")).alias("rate"), "count",
    )
    return ranked.orderBy(F.col("rate").desc(), "series_id")
