"""Fixed-width min/avg/max rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktide.functions.labels import labels_of
from sparktide.functions.times import floor_to, unix_second

MINUTE_S = 60
HOUR_S = 3600


NAN = float("nan")


def _numbers_only(value: str) -> Column:
    return F.when(~F.isnan(value), F.col(value))


def bucket_stats(value: str = "value") -> list[Column]:
    """Aggregates of one bucket: min and max are NaN only when there is nothing else."""
    return [
        F.coalesce(F.min(_numbers_only(value)), F.lit(NAN)).alias("min"),
        F.avg(value).alias("avg"),
        F.coalesce(F.max(_numbers_only(value)), F.lit(NAN)).alias("max"),
    ]


def bucket_parts(samples: DataFrame, width_s: int) -> DataFrame:
    """Per series and bucket what coarser buckets can be made of: ``low``, ``high``, ``total`` and ``points``."""
    keyed = samples.select("name", "series_id", floor_to(unix_second("ts"), width_s).alias("start"), "value")
    return keyed.groupBy("name", "series_id", "start").agg(
        F.min(_numbers_only("value")).alias("low"), F.max(_numbers_only("value")).alias("high"),
        F.sum("value").alias("total"), F.count("value").alias("points"),
    )


def coarser_parts(parts: DataFrame, width_s: int) -> DataFrame:
    """The same for wider buckets, from narrower ones that divide them; the samples are not read again."""
    return parts.withColumn("start", floor_to(F.col("start"), width_s)).groupBy("name", "series_id", "start").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("points").alias("points"),
    )


def rollup_of(parts: DataFrame, *, closed_only: bool = False, day: bool = False) -> DataFrame:
    """Rollup rows out of bucket parts; ``day`` keeps the ``ts_day`` of a stored table, which prunes."""
    if closed_only:
        # a series has one row per bucket here, so this window is small
        newest = F.max("start").over(Window.partitionBy("name", "series_id"))
        parts = parts.withColumn("_newest", newest).where(F.col("start") < F.col("_newest"))
    return parts.select(
        "name", labels_of(F.col("series_id")).alias("labels"), "series_id", F.timestamp_seconds("start").alias("bucket"),
        F.coalesce("low", F.lit(NAN)).alias("min"), (F.col("total") / F.nullif(F.col("points"), F.lit(0))).alias("avg"),
        F.coalesce("high", F.lit(NAN)).alias("max"), *(["ts_day"] if day else []),
    )


def rollup(samples: DataFrame, width_s: int, *, closed_only: bool = False) -> DataFrame:
    """Min, average and maximum per series and bucket of ``width_s`` seconds.

    A hash aggregate on (name, series_id, bucket) with map-side partials, so a
    hot series is reduced before the shuffle; the label map is rebuilt after it.  ``closed_only`` withholds the newest
    bucket of every series, as a store that flushes on the next bucket does.
    """
    return rollup_of(bucket_parts(samples, width_s), closed_only=closed_only)


def zip_subseries(points: DataFrame) -> DataFrame:
    """One row per bucket from long-form ``name#min``, ``name#avg``, ``name#max`` points.

    For tables that arrive with the three values as separate series; buckets
    missing one of the three are left out.
    """
    kind = F.substring_index("name", "#", -1)
    base = F.expr("left(name, length(name) - 4)")
    long = points.select(
        base.alias("name"), "labels", kind.alias("kind"), F.col("ts").alias("bucket"), "value"
    ).where(F.col("kind").isin("min", "avg", "max"))
    wide = long.groupBy("name", "labels", "bucket").pivot("kind", ["min", "avg", "max"]).agg(F.max("value"))
    return wide.where(F.col("min").isNotNull() & F.col("avg").isNotNull() & F.col("max").isNotNull())
