"""Incremental export rows and queries over the shared lake table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.functions.labels import labels_json

# (since, now) -> rows of the lake schema plus labels
DeltaSource = Callable[[object, object], DataFrame]


def lake_rows(minutes: DataFrame, node_id: Column | str, hostname: Column | str) -> DataFrame:
    """Minute buckets as export rows: the average is the value, the flag is always false."""
    node = F.lit(node_id) if isinstance(node_id, str) else node_id
    host = F.lit(hostname) if isinstance(hostname, str) else hostname
    return minutes.select(
        node.alias("node_id"), host.alias("hostname"), F.col("name").alias("metric_name"),
        labels_json(F.col("labels")).alias("labels_json"), F.col("bucket").alias("ts"),
        F.col("avg").alias("value"), F.lit(False).alias("anomaly_bit"), F.to_date("bucket").alias("ts_day"),
    )


def delta_since(minutes: DataFrame, since, now, node_id: Column | str, hostname: Column | str) -> DataFrame:
    """Export rows of the buckets in ``(since, now]``; ``since=None`` is from the beginning."""
    if since is not None:
        minutes = minutes.where(F.col("bucket") > F.lit(since))
    if now is not None:
        minutes = minutes.where(F.col("bucket") <= F.lit(now))
    return lake_rows(minutes, node_id, hostname)


def delta_watermark(rows: DataFrame, since) -> DataFrame:
    """Newest exported time, or ``since`` unchanged when there was nothing."""
    return rows.agg(F.coalesce(F.max("ts"), F.lit(since).cast("timestamp")).alias("watermark"))


def local_source(minutes: DataFrame, node_id: str, hostname: str) -> DeltaSource:
    return lambda since, now: delta_since(minutes, since, now, node_id, hostname)


def federated_query(
    lake: DataFrame,
    *,
    nodes: Sequence[str] | None = None,
    start=None,
    end=None,
    metric: str | None = None,
    labels: Mapping[str, str] | None = None,
    dedupe: bool = False,
) -> DataFrame:
    """Rows of many nodes from the lake table.

    Node and day bounds prune directories; ``dedupe`` drops the copies an
    at-least-once export may have left.
    """
    if nodes is not None:
        lake = lake.where(F.col("node_id").isin(*nodes))
    if start is not None:
        lake = lake.where((F.col("ts") >= F.lit(start)) & (F.col("ts_day") >= F.to_date(F.lit(start))))
    if end is not None:
        lake = lake.where((F.col("ts") <= F.lit(end)) & (F.col("ts_day") <= F.to_date(F.lit(end))))
    if metric is not None:
        lake = lake.where(F.col("metric_name") == metric)
    for key, want in (labels or {}).items():
        lake = lake.where(F.coalesce(F.try_element_at(
            F.from_json("labels_json", "map<string,string>"), F.lit(key)), F.lit("")) == want)
    if dedupe:
        lake = lake.dropDuplicates(["node_id", "metric_name", "labels_json", "ts"])
    return lake
