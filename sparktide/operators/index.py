"""Series index: which series there are, and which have a label, without reading points."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktide.functions.labels import labels_of
from sparktide.operators.select import select_series

#: Most ids that are written into a filter; beyond it the series are joined.
MAX_LISTED = 1000

INDEX = "name string, key string, value string, series_id string"


def index_rows(series: DataFrame) -> DataFrame:
    """One row for each label pair of each series, and one with an empty key for the series itself."""
    itself = F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value")))
    pairs = F.concat(itself, F.map_entries(labels_of(F.col("series_id"))))
    return series.select("name", "series_id", F.explode(pairs).alias("_p")).select("name", F.col("_p.key").alias("key"), F.col("_p.value").alias("value"), "series_id")


def find_series(index: DataFrame, name: str | None = None, labels: Mapping[str, str] | None = None, *, prefix: str | None = None) -> DataFrame:
    """``name`` and ``series_id`` of the series that carry all labels; a label that is missing equals ``""``.

    Reads the rows of the wanted keys only; a series that lacks a key has no row for it.
    """
    match = {k: v for k, v in (labels or {}).items()}
    rows = select_series(index, name, prefix=prefix).where(F.col("key").isin("", *match))

    def has(key: str, want: str) -> Column:
        if want:
            return F.coalesce(F.bool_or((F.col("key") == key) & (F.col("value") == want)), F.lit(False))
        return ~F.coalesce(F.bool_or((F.col("key") == key) & (F.col("value") != "")), F.lit(False))

    found = rows.groupBy("name", "series_id").agg(F.lit(True).alias("_any"), *(has(k, v).alias(f"_has{i}") for i, (k, v) in enumerate(match.items())))
    for i in range(len(match)):
        found = found.where(F.col(f"_has{i}"))
    return found.select("name", "series_id")


def indexed_series(index: DataFrame) -> DataFrame:
    """All series in canonical order, as :func:`~sparktide.operators.select.list_series` gives them from samples."""
    found = index.where(F.col("key") == "").select("series_id", "name")
    return found.withColumn("labels", labels_of(F.col("series_id"))).orderBy("series_id")


def indexed_metrics(index: DataFrame, prefix: str | None = None) -> DataFrame:
    """All metric names in order."""
    return select_series(index.where(F.col("key") == ""), prefix=prefix).select("name").distinct().orderBy("name")


def of_series(points: DataFrame, found: DataFrame) -> DataFrame:
    """Points of the series found.

    A few ids go into the filter, which the scan of a table sorted by series
    uses to skip row groups; more of them are met in a join.
    """
    ids = [r["series_id"] for r in found.select("series_id").limit(MAX_LISTED + 1).collect()]
    if len(ids) <= MAX_LISTED:
        return points.where(F.col("series_id").isin(ids) if ids else F.lit(False))
    return points.join(found.select("series_id"), "series_id", "left_semi").select(*points.columns)
