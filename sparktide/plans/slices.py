"""Time slices: windows over one series without one task per series.

A window partitioned by ``series_id`` puts a whole series into one task, and
one series may hold a third of a table.  The operators therefore partition
their windows by ``(series_id, slice)``, a slice being a fixed stretch of event
time, and bring along the few rows before the slice that the window needs:

* :func:`with_rows_before` - the last *k* rows (lags, rolling means),
* :func:`with_time_before` - all rows of the last *s* seconds (range frames).

The added rows carry ``is_context`` and are dropped after the window.  Both
return the union *before* the shuffle, so the samples move once.  A slice of
stored points (one per second) holds at most ``slice_s`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktide.functions.times import floor_to, unix_second

SLICE_SECONDS = 6 * 3600


def with_slice(df: DataFrame, slice_s: int = SLICE_SECONDS, ts: str = "ts") -> DataFrame:
    """Add ``slice``, the start second of the row's slice."""
    return df.withColumn("slice", floor_to(unix_second(ts), slice_s))


def slice_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "slice").orderBy(*order)


def tails(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], k: int) -> DataFrame:
    """Last ``k`` rows of every slice as one sorted array per (keys, slice).

    The rank filter is applied on the map side first, so only ``k`` rows per
    slice and input partition are shuffled.
    """
    fields = list(dict.fromkeys([*order, *cols]))
    newest = Window.partitionBy(*keys, "slice").orderBy(*[F.col(c).desc() for c in order])
    return (
        df.select(*keys, "slice", *fields)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= k)
        .groupBy(*keys, "slice")
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("tail"))
    )


def with_rows_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    k: int,
    slice_s: int = SLICE_SECONDS,
) -> DataFrame:
    """``df`` plus, in every slice, the last ``k`` rows that precede it.

    Only ``cols`` (and keys and order) are filled in on the added rows.
    """
    sliced = with_slice(df, slice_s)
    fields = list(dict.fromkeys([*order, *cols]))
    # any non-empty slice holds at least one row, so k earlier slices suffice
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(-k, -1)
    before = F.flatten(F.collect_list("tail").over(earlier))
    context = (
        tails(sliced, keys, order, cols, k)
        .select(*keys, "slice", before.alias("_before"))
        .select(*keys, "slice", F.explode(last_of(F.col("_before"), k)).alias("_row"))
        .select(*keys, "slice", *[F.col(f"_row.{c}").alias(c) for c in fields], F.lit(True).alias("is_context"))
    )
    return sliced.withColumn("is_context", F.lit(False)).unionByName(context, allowMissingColumns=True)


def last_of(array: Column, k: int) -> Column:
    """The last ``k`` elements."""
    return F.slice(array, F.greatest(F.size(array) - k + 1, F.lit(1)), F.lit(k))


def with_time_before(df: DataFrame, seconds: int | Column, slice_s: int = SLICE_SECONDS) -> DataFrame:
    """``df`` plus, in every slice, the rows of the ``seconds`` before it.

    A row is copied into a later slice only if it lies within reach of it, so
    with ``slice_s`` well above ``seconds`` few rows are copied and none is
    shuffled to find them.
    """
    sec = unix_second("ts")
    home = floor_to(sec, slice_s)
    ahead = seconds if isinstance(seconds, Column) else F.lit(int(seconds))
    reach = floor_to(sec + ahead.cast("long"), slice_s)
    slices = F.explode(F.sequence(home, reach, F.lit(int(slice_s)).cast("long")))
    return df.withColumn("slice", slices).withColumn("is_context", F.col("slice") > home)
