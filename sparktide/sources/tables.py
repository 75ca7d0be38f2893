"""Samples out of ordinary tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.functions.labels import series_id_from
from sparktide.schema import normalize_samples


def samples_from_table(
    df: DataFrame,
    *,
    name: Column | str,
    ts: Column | str,
    value: Column | str,
    labels: Mapping[str, Column] | None = None,
    seq: Column | str | None = None,
    interval_s: Column | float | None = None,
    anomalous: Column | None = None,
    with_day: bool = False,
) -> DataFrame:
    """Normal samples out of any table.

    ``name`` and the labels are columns (a string name is a literal metric
    name); ``ts``, ``value`` and ``seq`` may be column names.
    """
    def column(x):
        return F.col(x) if isinstance(x, str) else x

    name = F.lit(name) if isinstance(name, str) else name
    texts = {k: v.cast("string") for k, v in (labels or {}).items()}
    fields = [
        name.alias("name"), column(ts).alias("ts"), column(value).alias("value"),
        series_id_from(name, texts).alias("series_id"),
    ]
    if texts:
        fields.append(F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), v)]).alias("labels"))
    if seq is not None:
        fields.append(column(seq).alias("seq"))
    if interval_s is not None:
        fields.append((F.lit(interval_s) if not isinstance(interval_s, Column) else interval_s).alias("interval_s"))
    if anomalous is not None:
        fields.append(anomalous.alias("anomalous"))
    return normalize_samples(df.select(*fields), with_day=with_day)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``sinks.lake.write_samples``."""
    return spark.read.parquet(path)
