"""Streaming export to the lake table and forwarding of raw points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparktide.operators.export import lake_rows
from sparktide.sinks.matrix import timeseries_batches
from sparktide.sinks.snapshots import Snapshots
from sparktide.sources.remote_write import encode_remote_write


def stream_export(minutes: DataFrame, node_id: Column | str, hostname: Column | str) -> DataFrame:
    """Lake rows of a stream of closed minute buckets.

    Progress is the query's checkpoint instead of one global watermark, so a
    bucket that closes late is exported late, not lost.
    """
    return lake_rows(minutes, node_id, hostname)


def start_export(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything new to the partitioned lake table and stop; run it from any scheduler."""
    return (
        rows.writeStream.format("parquet").outputMode("append").partitionBy("ts_day", "node_id")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_forward(
    deliver: Callable[[DataFrame, int], None], since: Column | None = None, *, progress: str | None = None, interval_s: float | None = None,
):
    """A ``foreachBatch`` function that hands each batch to ``deliver`` as wire bodies.

    ``since`` bounds the first run for all series: samples up to then are not
    sent, so a new receiver need not take all history.  ``progress`` names a
    folder for a table with one row per series, the newest time it has had:
    a series that is not in it yet sends its last ``interval_s`` seconds only,
    counted from the newest time of all series, and everything from then on.

    A body holds one series piece.  A batch counts as sent only after
    ``deliver`` returned, so a failed delivery is repeated; a batch whose
    progress is stored is not sent again.
    """
    if progress is not None and interval_s is None:
        raise ValueError("progress by series needs the interval of a first run")

    def bodies(batch: DataFrame) -> DataFrame:
        return encode_remote_write(timeseries_batches(batch if since is None else batch.where(F.col("ts") > since)))

    def forward(batch: DataFrame, batch_id: int) -> None:
        if progress is None:
            deliver(bodies(batch), batch_id)
            return
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        store = Snapshots(spark, progress)
        base = store.latest()
        if batch_id + 1 <= base.calls.get(query, 0):
            return
        seen = batch.groupBy("series_id").agg(F.max("ts").alias("newest"))
        known = store.read("series", base)
        every = seen if known is None else seen.unionByName(known).groupBy("series_id").agg(F.max("newest").alias("newest"))
        clock = every.agg(F.max("newest")).first()[0]
        recent = F.col("ts") >= F.timestamp_micros(F.unix_micros(F.lit(clock)) - int(interval_s * 1e6)) if clock is not None else F.lit(True)
        if known is None:
            fresh = batch.where(recent)
        else:
            fresh = batch.join(known.select("series_id", F.lit(True).alias("_known")), "series_id", "left").where(F.col("_known") | recent).drop("_known")
        deliver(bodies(fresh), batch_id)
        part = store.new_part(batch_id + 1)
        store.write("series", every, part)
        new = base if clock is None else base.with_rows("series", every.schema, [""], part, instead=True)
        store.commit(base, new, batch_id + 1, query)

    return forward
