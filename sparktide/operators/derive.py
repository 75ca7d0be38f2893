"""Values derived from points: rates, sums, joins of series, time axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.functions.labels import label, labels_of
from sparktide.functions.numbers import clip_pct
from sparktide.plans.slices import SLICE_SECONDS, slice_window, with_rows_before

# Upper bounds of the default duration histogram, in seconds.
DURATION_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counter_rate(points: DataFrame, slice_s: int = SLICE_SECONDS) -> DataFrame:
    """Per-second rate between consecutive points of each series.

    A step with no elapsed time or a falling counter gives no row; the next
    step starts from the point after the reset.  Points of one time are taken
    in ``seq`` order, if there is one, and those of one arrival by value.
    """
    order = ["ts", *(["seq"] if "seq" in points.columns else []), "value"]
    rows = with_rows_before(points, ["series_id"], order, ["value"], 1, slice_s)
    w = slice_window(["series_id"], order)
    gone = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6
    rise = F.col("value") - F.lag("value").over(w)
    return (
        rows.withColumn("_dt", gone).withColumn("_dv", rise)
        .where(~F.col("is_context") & (F.col("_dt") > 0) & (F.col("_dv") >= 0) & ~F.isnan("_dv"))
        .withColumn("rate", F.col("_dv") / F.col("_dt"))
        .drop("_dt", "_dv", "slice", "is_context")
    )


def rate_sum(points: DataFrame, name: str | None = None, where: Column | None = None) -> DataFrame:
    """Sum of the rates of all (matching) series at equal times."""
    if name is not None:
        points = points.where(F.col("name") == name)
    if where is not None:
        points = points.where(where)
    return counter_rate(points).groupBy("ts").agg(F.sum("rate").alias("rate"))


def server_errors(labels: str = "labels") -> Column:
    """Label predicate: a ``status`` of the 5xx class."""
    return F.coalesce(label(F.col(labels), "status").startswith("5"), F.lit(False))


def cpu_busy_percent(points: DataFrame, *, per_cpu: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Busy percentage from idle-time counters: 100 - 100 x mean idle rate, clamped.

    ``by`` names labels kept apart (``instance``); ``per_cpu`` gives one line per CPU.
    """
    idle = points.where(
        (F.col("name") == "node_cpu_seconds_total") & (label(F.col("labels"), "mode") == "idle")
    )
    keep = list(by) + (["cpu"] if per_cpu else [])
    named = [label(F.col("labels"), k).alias(k) for k in keep]
    rates = counter_rate(idle).select("ts", "rate", *named)
    mean = rates.groupBy(*keep, "ts").agg(F.avg("rate").alias("_idle"))
    return mean.withColumn("busy", clip_pct(100 - F.col("_idle") * 100)).drop("_idle")


def cpu_busy_gauge(points: DataFrame) -> DataFrame:
    """Busy percentage where idle is already a gauge: 100 - idle."""
    idle = points.where(
        (F.col("name") == "node_cpu_usage_percent") & (label(F.col("labels"), "mode") == "idle")
    )
    return idle.select("series_id", "ts", (100 - F.col("value")).alias("busy"))


def _used(total: Column, spare: Column) -> Column:
    # IEEE division: 0/0 is NaN and x/0 infinite, instead of null
    share = F.when(total != 0, spare / total).when(spare == 0, F.lit(float("nan"))).otherwise(
        F.when(spare > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    )
    return clip_pct(100 * (1 - share))


def _label_text() -> Column:
    """What a series id says besides the name: equal for series with equal labels."""
    series = F.col("series_id")
    return F.substring(series, F.locate("{", series), F.length(series))


def _keyed(points: DataFrame, by: Sequence[str] | None) -> DataFrame:
    return points if by is None else points.select("name", "ts", "value", *[label(F.col("labels"), k).alias(k) for k in by])


def used_percent(total: DataFrame, spare: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """100 x (1 - spare / total) where both have a point at the same time, clamped.

    Series meet that have all labels but the name in common, and the result
    keeps these ``labels``; ``by`` names columns both sides share to pair on
    instead.  A shuffle join with the time among its keys, which spreads them
    even when one group is hot.
    """
    keys = ["ts", "_who"] if by is None else [*by, "ts"]
    if by is None:
        total, spare = total.withColumn("_who", _label_text()), spare.withColumn("_who", _label_text())
    left = total.select(*keys, F.col("value").alias("_total"))
    right = spare.select(*keys, F.col("value").alias("_spare"))
    used = _used(F.col("_total"), F.col("_spare")).alias("used")
    shown = [labels_of(F.col("_who")).alias("labels"), "ts"] if by is None else keys
    return left.join(right, keys).select(*shown, used)


def memory_used_percent(points: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Used memory from (MemTotal, MemAvailable) or, on macOS hosts, (total, free); paired as in ``used_percent``."""
    keyed = _keyed(points, by)

    def metric(kind: str) -> DataFrame:
        return keyed.where(F.col("name") == f"node_memory_{kind}_bytes")

    linux = used_percent(metric("MemTotal"), metric("MemAvailable"), by)
    return linux.unionByName(used_percent(metric("total"), metric("free"), by))


def filesystem_used_percent(points: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Used share of every mount that reports both size and available bytes; paired as in ``used_percent``."""
    keyed = _keyed(points, by)
    size = keyed.where(F.col("name") == "node_filesystem_size_bytes")
    avail = keyed.where(F.col("name") == "node_filesystem_avail_bytes")
    return used_percent(size, avail, by)


def avg_latency_ms(sums: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean duration in ms: 1000 x rate of the sums / rate of the counts.

    Both sides are summed over their series first; times without a count rate
    are left out.
    """
    total = rate_sum(sums).withColumnRenamed("rate", "_sum")
    count = rate_sum(counts).withColumnRenamed("rate", "_count")
    return (
        total.join(count, "ts").where(F.col("_count") != 0)
        .select("ts", (1000 * F.col("_sum") / F.col("_count")).alias("avg_ms"))
    )


def primary_network_rate(points: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Receive and transmit rates of the interface that carries the default route.

    An interface is primary if a ``primary_info`` series has the same labels,
    so one host says nothing about another, and the result keeps the ``labels``
    without the device; ``by`` names the labels to pair and group on instead.
    """
    if by is None:
        keys, keyed = ["_who"], points.withColumn("_who", _label_text())
    else:
        keys, keyed = [*by, "device"], points
        for key in keys:
            keyed = keyed.withColumn(key, label(F.col("labels"), key))
    primary = keyed.where(F.col("name") == "node_network_primary_info").select(*keys).distinct()
    wires = keyed.where(F.col("name").isin("node_network_receive_bytes_total", "node_network_transmit_bytes_total"))
    rates = counter_rate(wires.join(primary, keys, "left_semi"))
    if by is None:
        rates = rates.withColumn("_host", F.to_json(F.map_filter(labels_of(F.col("_who")), lambda k, _: k != F.lit("device"))))
        both = _two_ways(rates, ["_host", "ts"])
        return both.select(F.from_json("_host", "map<string,string>").alias("labels"), "ts", "rx", "tx")
    return _two_ways(rates, [*by, "ts"])


def _two_ways(rates: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rates.groupBy(*keys).agg(
        F.sum(F.when(F.col("name") == "node_network_receive_bytes_total", F.col("rate"))).alias("rx"),
        F.sum(F.when(F.col("name") == "node_network_transmit_bytes_total", F.col("rate"))).alias("tx"),
    )


def rates_by_time(points: DataFrame, names: dict[str, str]) -> DataFrame:
    """Summed rates of several metrics on one time axis; ``names`` maps metric to column."""
    rates = counter_rate(points.where(F.col("name").isin(*names)))
    return rates.groupBy("ts").agg(
        *[F.sum(F.when(F.col("name") == metric, F.col("rate"))).alias(col) for metric, col in names.items()]
    )


def align_series(points: DataFrame, key: str, values: Sequence[str], *, value: str = "value") -> DataFrame:
    """One column per listed value of ``key`` on the union of all times, null in the gaps.

    For values known beforehand; ``align_points`` takes any number of them.
    Two series with the same value of ``key`` at one time are an error of the
    job, as one cell cannot hold both.
    """
    some = F.array_compact(F.collect_set(F.struct("series_id", value)))
    one = F.when(F.size(some) > 1, F.raise_error(F.lit(f"several series share one {key} at a time"))).otherwise(F.get(some, F.lit(0))[value])
    listed = points.where(F.col(key).isin(*values) & F.col(value).isNotNull())
    wide = listed.groupBy("ts").pivot(key, list(values)).agg(one)
    times = points.select("ts").distinct()
    return times.join(wide, "ts", "left").orderBy("ts")


def align_points(points: DataFrame, key: str, *, value: str = "value", order: str = "text") -> DataFrame:
    """The same in long form: ``ts``, ``key``, ``series_id`` and ``value``, by time, then key, then series.

    Nothing is gathered, so any number of keys will do and series that share
    one stay apart.  ``order="numeric"`` puts 2 before 10, and values that are
    no numbers last.
    """
    if order not in ("text", "numeric"):
        raise ValueError(f"order must be text or numeric, not {order}")
    by = [F.col(key).try_cast("double").asc_nulls_last()] if order == "numeric" else []
    return points.select("ts", key, "series_id", value).orderBy("ts", *by, key, "series_id")


def red_summary(
    requests: DataFrame,
    by: Sequence[str],
    duration: str,
    failed: Column,
    bounds: Sequence[float] = DURATION_BOUNDS,
) -> DataFrame:
    """Requests, errors and a cumulative duration histogram per label set."""
    d = F.col(duration)
    return requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(failed).alias("errors"),
        F.sum(d).alias("duration_sum"),
        F.count(d).alias("duration_count"),
        *[F.count_if(d <= F.lit(float(b))).alias(f"le_{b:g}".replace(".", "_")) for b in bounds],
        F.count(d).alias("le_inf"),
    )


def flatten_cumulative(families: DataFrame) -> DataFrame:
    """Families to plain readings.

    Input rows are ``name, type, labels, value, sum, count``.  A histogram or
    summary gives its ``_sum`` and ``_count``; ``cumulative`` marks the readings
    a rate should be taken of.
    """
    def reading(suffix: str, column: str, cumulative: Column) -> Column:
        return F.struct(
            F.concat("name", F.lit(suffix)).alias("name"),
            F.col(column).cast("double").alias("value"),
            cumulative.alias("cumulative"),
        )

    compound = F.array(reading("_sum", "sum", F.lit(True)), reading("_count", "count", F.lit(True)))
    plain = F.array(reading("", "value", F.col("type") == "counter"))
    rows = F.when(F.col("type").isin("histogram", "summary"), compound).otherwise(plain)
    return families.select("labels", F.explode(rows).alias("r")).select("r.name", "labels", "r.value", "r.cumulative")


