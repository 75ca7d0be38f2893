"""Finding series and points: filters, catalogue, latest values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktide.functions.labels import label_match, labels_of

# Fixed value: how far back the latest-value report looks.
LATEST_LOOKBACK_S = 300
# What follows # in the name of a rollup value sent as a series.
ROLLUP_PARTS = ("min", "avg", "max")


def select_series(
    df: DataFrame,
    name: str | None = None,
    labels: Mapping[str, str] | None = None,
    *,
    prefix: str | None = None,
) -> DataFrame:
    """Rows of the named metric (or of all metrics with a prefix) matching ``labels``."""
    if name is not None:
        df = df.where(F.col("name") == name)
    if prefix is not None:
        df = df.where(F.col("name").startswith(prefix))
    if labels:
        df = df.where(label_match(F.col("labels"), labels))
    return df


def time_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Rows in ``[start, end]``, both ends included.

    A bound on ``ts`` cannot prune ``ts_day`` directories, so the day bounds
    are added whenever that column exists.
    """
    if isinstance(start, str) or isinstance(end, str):
        start, end = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    else:
        start, end = F.lit(start), F.lit(end)
    df = df.where(F.col(ts).between(start, end))
    if "ts_day" in df.columns:
        df = df.where(F.col("ts_day").between(F.to_date(start), F.to_date(end)))
    return df


def _own(samples: DataFrame) -> DataFrame:
    return samples.where(~F.substring_index("name", "#", -1).isin(*ROLLUP_PARTS) | ~F.col("name").contains("#"))


def list_series(samples: DataFrame) -> DataFrame:
    """Distinct series, in canonical order; the parts of a rollup kept in long form are no series of their own."""
    found = _own(samples).select("name", "series_id").distinct()
    return found.select("series_id", "name", labels_of(F.col("series_id")).alias("labels")).orderBy("series_id")


def list_metrics(samples: DataFrame, prefix: str | None = None) -> DataFrame:
    """Distinct metric names in order, without the parts of rollups."""
    return select_series(_own(samples), prefix=prefix).select("name").distinct().orderBy("name")


def latest_per_series(points: DataFrame, now: Column | None = None, lookback_s: int | None = None) -> DataFrame:
    """Newest point of each series, optionally only from ``[now - lookback, now]``.

    ``max_by`` merges on the map side, so a hot series costs one row per task.
    """
    if now is not None:
        back = LATEST_LOOKBACK_S if lookback_s is None else lookback_s
        points = points.where(F.col("ts").between(now - F.expr(f"INTERVAL {int(back)} SECONDS"), now))
    # of several samples at one time the last to arrive counts
    order = F.struct("ts", "seq") if "seq" in points.columns else F.col("ts")
    newest = points.groupBy("name", "series_id").agg(F.max("ts").alias("ts"), F.max_by("value", order).alias("value"))
    return newest.withColumn("labels", labels_of(F.col("series_id")))


def latest_sum(points: DataFrame, name: str) -> DataFrame:
    """Sum over the series of one metric of each series' latest value."""
    newest = latest_per_series(points.where(F.col("name") == name))
    return newest.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def last_n(points: DataFrame, n: int, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Newest ``n`` points of each series.

    The rank filter runs before the shuffle as well, so a hot series sends at
    most ``n`` rows per input partition.
    """
    order = (*order, "seq") if "seq" in points.columns and "seq" not in order else order
    newest = Window.partitionBy("series_id").orderBy(*[F.col(c).desc() for c in order])
    return points.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")
