"""Table schemas and the normal form every source is brought to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktide.functions.labels import empty_labels, series_id
from sparktide.functions.times import unix_second

LABELS = T.MapType(T.StringType(), T.StringType())

SAMPLES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("labels", LABELS),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("interval_s", T.DoubleType()),
    T.StructField("anomalous", T.BooleanType()),
    T.StructField("seq", T.LongType()),
])

#: Samples in normal form, and points as a tier stores them.
POINTS = T.StructType([
    SAMPLES["name"], SAMPLES["labels"], T.StructField("series_id", T.StringType()), *(SAMPLES[c] for c in ("ts", "value", "interval_s", "anomalous", "seq")),
    T.StructField("sec", T.LongType()),
])

ROLLUP = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("labels", LABELS),
    T.StructField("series_id", T.StringType()),
    T.StructField("bucket", T.TimestampType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("avg", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
])

RULES = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("rule_labels", LABELS),
    T.StructField("cond_type", T.StringType()),
    T.StructField("operator", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("window_s", T.DoubleType()),
    T.StructField("for_s", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("notify", T.ArrayType(T.StringType())),
    T.StructField("silent_s", T.DoubleType()),
])

NOTIFIERS = T.StructType([
    T.StructField("notifier", T.StringType()),
    T.StructField("type", T.StringType()),
])

MODELS = T.StructType([
    T.StructField("series_id", T.StringType()),
    T.StructField("trained_at", T.TimestampType()),
    T.StructField("c0", T.ArrayType(T.DoubleType())),
    T.StructField("c1", T.ArrayType(T.DoubleType())),
    T.StructField("min_dist", T.DoubleType()),
    T.StructField("max_dist", T.DoubleType()),
])

LAKE = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("labels_json", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("anomaly_bit", T.BooleanType()),
    T.StructField("ts_day", T.DateType()),
])


def normalize_samples(df: DataFrame, *, with_day: bool = False) -> DataFrame:
    """Fill the defaults of a source frame and add ``series_id`` and ``sec``.

    Needs ``name``, ``ts`` and ``value``.  ``labels`` defaults to none,
    ``interval_s`` to one second when missing or not positive, ``anomalous`` to
    false and ``seq`` (the arrival order) to the microsecond of ``ts``, which the
    column's metadata then says.  ``ts``
    keeps its full precision, ``sec`` is the whole second stored tiers use.  A
    ``series_id`` the source already has is kept.
    """
    have = set(df.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    labels = given("labels", empty_labels())
    interval = F.col("interval_s") if "interval_s" in have else F.lit(None)
    out = df.select(
        "name",
        labels.alias("labels"),
        (F.col("series_id") if "series_id" in have else series_id(F.col("name"), labels)).alias("series_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("double").alias("value"),
        F.when(interval > 0, interval).otherwise(F.lit(1.0)).cast("double").alias("interval_s"),
        given("anomalous", F.lit(False)).alias("anomalous"),
        given("seq", F.unix_micros(F.col("ts").cast("timestamp"))).cast("long").alias("seq", metadata={"from_time": "seq" not in have}),
    ).withColumn("sec", unix_second("ts"))
    if with_day:
        out = out.withColumn("ts_day", F.to_date("ts"))
    return out


def union_sources(*sources: DataFrame) -> DataFrame:
    """One sample frame out of many sources of the same normal form."""
    if not sources:
        raise ValueError("at least one source is needed")
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
