"""What a tier keeps: arrival-order dedup, ring and plain retention, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktide.functions.times import floor_to, unix_second
from sparktide.plans.slices import SLICE_SECONDS, with_slice

# Ring slots per series, bytes per stored (time, value) pair,
# default compression ratio, sub-series per rollup bucket.
RING_SLOTS = 8
POINT_BYTES = 16
COMPRESSION_RATIO = 3.14
ROLLUP_SUBSERIES = 3

# Seconds each tier is kept by default.
RETENTION_S = {"raw": 2 * 3600, "minute": 7 * 86400, "hour": 365 * 86400}
TIER_INTERVAL_S = {"raw": 15, "minute": 60, "hour": 3600}

ARRIVALS_PER_SLICE = 1_000_000
MICROS_PER_SLICE = 6 * 3600 * 1_000_000


def arrivals_slice(samples: DataFrame) -> int:
    """Width of a stretch of ``seq``: arrivals, or six hours where ``seq`` is the time itself for want of an order."""
    return MICROS_PER_SLICE if samples.schema["seq"].metadata.get("from_time") else ARRIVALS_PER_SLICE


def arrival_carries(samples: DataFrame, arrivals_per_slice: int, newest: DataFrame | None = None) -> DataFrame:
    """Per series and stretch of ``seq`` the largest second that arrived in the stretches before it.

    ``newest`` (``name``, ``series_id``, ``sec``) is what came before all of
    them.  One row per stretch that has rows, made with map-side partials.
    """
    part = F.expr(f"seq - pmod(seq, {int(arrivals_per_slice)}L)")
    keys = ["name", "series_id"]
    parts = samples.groupBy(*keys, part.alias("_part")).agg(F.max("sec").alias("_part_max"))
    earlier_parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, "_part", F.max("_part_max").over(earlier_parts).alias("_carry"))
    if newest is None:
        return carried
    known = newest.select(*keys, F.col("sec").alias("_known"))
    return carried.join(known, keys, "left").select(*keys, "_part", F.greatest("_carry", "_known").alias("_carry"))


def dedup_ordered(samples: DataFrame, arrivals_per_slice: int | None = None, newest: DataFrame | None = None) -> DataFrame:
    """Keep a sample only if its second exceeds every earlier-arrived one of its series.

    ``seq`` is the arrival order.  The running maximum is split by stretches of
    ``seq``: each stretch needs only the maximum of the stretches before it,
    which comes from a small pre-aggregated table.  A stretch is a million
    arrivals, or six hours of event time where the source had no order and
    ``seq`` was filled with the time.  Rows that share one ``seq`` stay in one
    stretch.  ``newest`` has the newest second that a table stores of each series already.

    The name is a key as well, though the id tells it, so that a filter on it
    reaches the scan.
    """
    size = arrivals_slice(samples) if arrivals_per_slice is None else arrivals_per_slice
    carried = arrival_carries(samples, size, newest)
    samples = samples.withColumn("_part", F.expr(f"seq - pmod(seq, {int(size)}L)"))
    # ties in seq are broken so that the earliest second of equal arrivals is kept first
    earlier = Window.partitionBy("name", "series_id", "_part").orderBy("seq", "ts", "value").rowsBetween(
        Window.unboundedPreceding, -1
    )
    seen = F.greatest(F.col("_carry"), F.max("sec").over(earlier))
    columns = [c for c in samples.columns if c != "_part"]
    return (
        samples.join(carried, ["name", "series_id", "_part"])
        .withColumn("_seen", seen)
        .where(F.col("_seen").isNull() | (F.col("sec") > F.col("_seen")))
        .select(*columns)
    )


def store_points(samples: DataFrame, arrivals_per_slice: int | None = None, newest: DataFrame | None = None) -> DataFrame:
    """Raw-tier points: deduplicated, times cut to whole seconds."""
    return dedup_ordered(samples, arrivals_per_slice, newest).withColumn("ts", F.timestamp_seconds("sec"))


def _chunk_seconds(interval_s: Column, retention_s: float) -> Column:
    points = F.greatest(F.floor(F.lit(float(retention_s)) / interval_s), F.lit(1))
    per_chunk = F.greatest(F.floor(points / RING_SLOTS), F.lit(1))
    return (per_chunk * F.greatest(F.floor(interval_s), F.lit(1))).cast("long")


def ring_retention(points: DataFrame, retention_s: float) -> DataFrame:
    """Keep what a ring of eight time-aligned chunks per series still holds.

    Chunk number ``n`` survives when it is the newest seen in slot ``n mod 8``.
    The newest chunks are a small aggregate; the points meet them in a
    semi-join keyed by (series, chunk), which spreads a hot series.
    """
    span = _chunk_seconds(F.col("interval_s"), retention_s)
    chunked = points.withColumn("_span", span).withColumn(
        "_chunk", F.expr("CAST((sec - pmod(sec, _span)) / _span AS BIGINT)")
    )
    kept = (
        chunked.groupBy("series_id", F.expr(f"pmod(_chunk, {RING_SLOTS}L)").alias("_slot"))
        .agg(F.max("_chunk").alias("_chunk"))
        .select("series_id", "_chunk")
    )
    return chunked.join(kept, ["series_id", "_chunk"], "left_semi").drop("_span", "_chunk")


def retention(points: DataFrame, retention_s: int, slice_s: int = SLICE_SECONDS) -> DataFrame:
    """Plain retention: points newer than the series' newest minus ``retention_s``.

    The bound of a series meets its points per slice of event time, so a hot
    series is spread; slices older than the bound meet nothing.
    """
    sliced = with_slice(points, slice_s)
    keys = ["name", "series_id"]
    parts = sliced.groupBy(*keys, "slice").agg(F.max("sec").alias("_max"))
    bound = F.max("_max").over(Window.partitionBy(*keys)) - F.lit(int(retention_s))
    kept = parts.withColumn("_from", bound).where(F.col("_max") > F.col("_from")).select(*keys, "slice", "_from")
    return sliced.join(kept, [*keys, "slice"]).where(F.col("sec") > F.col("_from")).select(*points.columns)


def tier_points(retention_s: float, interval_s: float) -> float:
    """Points one series gathers over a tier's retention; 0 when disabled."""
    return 0.0 if retention_s <= 0 or interval_s <= 0 else retention_s / interval_s


def _sizes(tier: str, series: Column, rows: Column, keep: dict, every: dict, ratio: float) -> Column:
    """One row of a report as a struct."""
    subseries = 1 if tier == "raw" else ROLLUP_SUBSERIES
    planned = tier_points(keep[tier], every[tier])
    bytes_planned = series * (subseries * POINT_BYTES) * F.lit(planned)
    return F.struct(
        F.lit(tier).alias("tier"), series.alias("series"), (rows * subseries).alias("points"), (rows * subseries * POINT_BYTES).alias("bytes"),
        F.lit(planned).alias("planned_points_per_series"), bytes_planned.alias("planned_bytes"),
        (bytes_planned / F.lit(float(ratio))).alias("planned_compressed_bytes"),
    )


def _plans(retention_s: dict[str, float] | None, raw_interval_s: float, ratio: float) -> tuple[dict, dict]:
    if ratio <= 0:
        raise ValueError("ratio must be positive")
    return {**RETENTION_S, **(retention_s or {})}, {**TIER_INTERVAL_S, "raw": raw_interval_s}


def sizing_of(
    samples: DataFrame,
    *,
    retention_s: dict[str, float] | None = None,
    raw_interval_s: float = TIER_INTERVAL_S["raw"],
    ratio: float = COMPRESSION_RATIO,
) -> DataFrame:
    """:func:`sizing_report` of the tiers that samples would make, in one pass over them.

    Samples are counted by minute, minutes by hour, hours by series; each step
    has partial sums before its shuffle and far fewer rows than the one before.
    """
    keep, every = _plans(retention_s, raw_interval_s, ratio)
    minute = samples.groupBy("series_id", floor_to(unix_second("ts"), 60).alias("_m")).agg(F.count(F.lit(1)).alias("raw"))
    hour = minute.groupBy("series_id", floor_to(F.col("_m"), 3600).alias("_h")).agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("minute"))
    series = hour.groupBy("series_id").agg(F.sum("raw").alias("raw"), F.sum("minute").alias("minute"), F.count(F.lit(1)).alias("hour"))
    total = series.agg(F.count(F.lit(1)).alias("series"), *(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TIER_INTERVAL_S))
    rows = F.array(*[_sizes(t, F.col("series"), F.col(t), keep, every, ratio) for t in TIER_INTERVAL_S])
    return total.select(F.inline(rows))


def sizing_report(
    raw: DataFrame,
    minute: DataFrame,
    hour: DataFrame,
    *,
    retention_s: dict[str, float] | None = None,
    raw_interval_s: float = TIER_INTERVAL_S["raw"],
    ratio: float = COMPRESSION_RATIO,
) -> DataFrame:
    """Actual and planned size of each tier.

    ``points`` and ``bytes`` count the tables as they are (a rollup bucket is
    three values); ``planned_bytes`` is series x retention / interval.
    """
    keep, every = _plans(retention_s, raw_interval_s, ratio)
    reports = [
        table.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("series"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        .select(F.inline(F.array(_sizes(tier, F.col("series"), F.col("rows"), keep, every, ratio))))
        for tier, table in (("raw", raw), ("minute", minute), ("hour", hour))
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])
