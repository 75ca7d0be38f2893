"""The main query: name + label filter + time range on one tier."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.operators.index import find_series, of_series
from sparktide.operators.select import select_series, time_range
from sparktide.schema import POINTS, ROLLUP

# Tier names, and the widest range each of the finer tiers serves.
TIERS = ("raw", "minute", "hour")
RAW_MAX_S = 3600
MINUTE_MAX_S = 7 * 86400


def auto_tier(range_s: float) -> str:
    """Tier to chart a range of this width from."""
    if range_s <= RAW_MAX_S:
        return "raw"
    return "minute" if range_s <= MINUTE_MAX_S else "hour"


def check_tier(tier: str | None) -> str:
    tier = tier or "raw"
    if tier not in TIERS:
        raise ValueError(f"invalid tier {tier}: want raw, minute, or hour")
    return tier


def parse_label_filter(text: str | None) -> dict[str, str]:
    """``k1=v1,k2=v2`` -> dict."""
    if not text:
        return {}
    pairs = [p.partition("=") for p in text.split(",")]
    for key, eq, value in pairs:
        if not eq:
            raise ValueError(f"expected k=v, got {key}")
    return {key: value for key, _, value in pairs}


def query_range(
    tiers: Mapping[str, DataFrame | None],
    metric: str,
    labels: Mapping[str, str] | str | None,
    start,
    end,
    tier: str | None = "raw",
    *,
    ordered: bool = True,
) -> DataFrame:
    """Points (or buckets) of the matching series in ``[start, end]``.

    ``tiers`` maps tier names to tables; a tier that is not kept gives an empty
    result.  Name and time bounds reach the scan, day bounds prune directories.
    """
    if not metric:
        raise ValueError("metric is required")
    if end < start:
        raise ValueError("end must not be before start")
    tier = check_tier(tier)
    match = parse_label_filter(labels) if isinstance(labels, str) else labels
    table = tiers.get(tier)
    if table is None:
        some = next(t for t in tiers.values() if t is not None)
        return some.sparkSession.createDataFrame([], POINTS if tier == "raw" else ROLLUP)
    stamp = "ts" if tier == "raw" else "bucket"
    found = time_range(select_series(table, metric, match), start, end, ts=stamp)
    return found.orderBy("series_id", stamp) if ordered else found


def indexed_range(tiers: Mapping[str, DataFrame | None], metric: str, labels, start, end, tier: str | None = "raw", *, ordered: bool = True) -> DataFrame:
    """:func:`query_range` over stored tiers whose series are looked up in the index first.

    The ids of the matching series reach the scan, so that of a metric with many
    series only the row groups of the wanted ones are read.
    """
    match = parse_label_filter(labels) if isinstance(labels, str) else labels
    table = tiers.get(check_tier(tier))
    if match and table is not None:
        tiers = {**tiers, check_tier(tier): of_series(table, find_series(tiers["series"], metric, match))}
    return query_range(tiers, metric, match, start, end, tier, ordered=ordered)


def empty_series(tiers: Mapping[str, DataFrame | None], metric: str, labels, start, end, tier: str = "raw") -> DataFrame:
    """Matching series of a tier that have no point in the range (they are listed too).

    Stored tiers have an index, ``series``, that says which series match; only the range is read then.
    """
    match = parse_label_filter(labels) if isinstance(labels, str) else labels
    if tiers.get("series") is not None:
        known = find_series(tiers["series"], metric, match)
    else:
        known = select_series(tiers[tier], metric, match).select("name", "series_id").distinct()
    seen = query_range(tiers, metric, match, start, end, tier, ordered=False).select("series_id").distinct()
    return known.join(seen, "series_id", "left_anti").select("series_id", F.col("name"))
