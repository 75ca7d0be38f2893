"""Matrix results and series batches: points gathered per series in bounded pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktide.functions.labels import json_text, labels_of, metric_labels, sorted_entries
from sparktide.functions.numbers import format_float
from sparktide.functions.times import floor_to, unix_second
from sparktide.plans.tiers import check_tier, empty_series, query_range

CHUNK_SECONDS = 6 * 3600
MAX_SAMPLES = 100_000


def _chunk(ts: str, start, chunk_s: int) -> Column:
    """Number of the piece a point belongs to, counted from the range start."""
    origin = unix_second(F.lit(start).cast("timestamp")) if start is not None else F.lit(0).cast("long")
    return (floor_to(unix_second(ts) - origin, chunk_s) / F.lit(chunk_s)).cast("long")


def _pairs(ts_text: str, value: str) -> Column:
    """JSON array of [seconds, "value"] pairs in time order."""
    ordered = F.sort_array(F.collect_list(F.struct("_us", F.concat(F.lit("["), F.col(ts_text), F.lit(',"'), F.col(value), F.lit('"]')).alias("p"))))
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(ordered, lambda x: x["p"])), F.lit("]"))


def _seconds_text(fractional: bool) -> Column:
    whole = F.expr("_us div 1000000").cast("string")
    part = F.pmod(F.col("_us"), F.lit(1_000_000))
    digits = F.regexp_replace(F.lpad(part.cast("string"), 6, "0"), "0+$", "")
    return F.when(part == 0, whole).otherwise(F.concat(whole, F.lit("."), digits)) if fractional else whole


def matrix_result(found: DataFrame, *, start=None, chunk_s: int = CHUNK_SECONDS) -> DataFrame:
    """JSON objects ``{"metric", "values", "min", "max"}`` of a query result.

    Values are text, times seconds.  A series comes in pieces of ``chunk_s``
    seconds numbered by ``chunk`` from ``start`` on, so that no group holds
    a whole long series; a range of up to ``chunk_s`` gives one piece.
    """
    tiered = "bucket" in found.columns
    stamp = "bucket" if tiered else "ts"
    rows = found.select(
        "name", "series_id", _chunk(stamp, start, chunk_s).alias("chunk"), F.unix_micros(stamp).alias("_us"),
        *([F.col("avg").alias("value"), "min", "max"] if tiered else ["value"]),
    ).withColumn("_t", _seconds_text(not tiered))
    columns = ["value", "min", "max"] if tiered else ["value"]
    for c in columns:
        rows = rows.withColumn(c, format_float(F.col(c)))
    packed = rows.groupBy("name", "series_id", "chunk").agg(
        F.count(F.lit(1)).alias("points"),
        *[_pairs("_t", c).alias("values" if c == "value" else c) for c in columns],
    )
    metric = F.to_json(F.map_from_entries(sorted_entries(metric_labels(F.col("name"), labels_of(F.col("series_id"))))))
    parts = [F.lit('{"metric":'), json_text(metric), F.lit(',"values":'), F.col("values")]
    if tiered:
        parts += [F.lit(',"min":'), F.col("min"), F.lit(',"max":'), F.col("max")]
    return packed.select("series_id", "chunk", "points", F.concat(*parts, F.lit("}")).alias("json"))


def empty_matrix(series: DataFrame, *, tiered: bool = False) -> DataFrame:
    """Matrix rows of matching series without a point in the range."""
    metric = F.to_json(F.map_from_entries(sorted_entries(metric_labels(F.col("name"), labels_of(F.col("series_id"))))))
    nothing = ',"values":[],"min":[],"max":[]}' if tiered else ',"values":[]}'
    return series.select(
        "series_id", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("points"),
        F.concat(F.lit('{"metric":'), json_text(metric), F.lit(nothing)).alias("json"),
    )


def matrix_query(tiers, metric: str, labels, start, end, tier: str | None = "raw", *, chunk_s: int = CHUNK_SECONDS) -> DataFrame:
    """The main query as matrix rows; a matching series without points in the range has one with empty values."""
    tier = check_tier(tier)
    found = matrix_result(query_range(tiers, metric, labels, start, end, tier, ordered=False), start=start, chunk_s=chunk_s)
    if tiers.get(tier) is None:
        return found
    return found.unionByName(empty_matrix(empty_series(tiers, metric, labels, start, end, tier), tiered=tier != "raw"))


def timeseries_batches(points: DataFrame, *, chunk_s: int = CHUNK_SECONDS, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Per series piece: label pairs (name included) and samples (value, milliseconds) in time order.

    A piece spans at most ``chunk_s`` seconds and holds at most ``max_samples``
    samples; ``piece`` numbers those of one stretch.  The rank is taken by a
    sort that spills, on the keys of the grouping, so nothing moves twice.
    """
    keys = ["name", "series_id", "chunk"]
    sample = F.struct(F.floor(F.unix_micros("ts") / 1000).cast("long").alias("ts_ms"), "value")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "value")) - 1
    rows = points.select("name", "series_id", "ts", "value", floor_to(unix_second("ts"), chunk_s).alias("chunk"))
    packed = rows.withColumn("piece", F.floor(rank / F.lit(int(max_samples))).cast("long")).groupBy(*keys, "piece").agg(
        F.sort_array(F.collect_list(sample)).alias("samples")
    )
    labels = sorted_entries(metric_labels(F.col("name"), labels_of(F.col("series_id"))))
    return packed.select("series_id", "chunk", "piece", labels.alias("labels"), "samples")
