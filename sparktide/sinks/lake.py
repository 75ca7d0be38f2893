"""Partitioned tables: samples and the shared export table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.functions.times import floor_to
from sparktide.operators.index import index_rows
from sparktide.operators.rollup import HOUR_S, MINUTE_S, bucket_parts, coarser_parts, rollup_of
from sparktide.operators.store import store_points
from sparktide.sinks.snapshots import DAY, PART, Snapshot, Snapshots, place


def write_lake(rows: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append export rows under ``ts_day=/node_id=``.

    The rebalance hint lets adaptive execution split a hot (day, node) over
    several files and merge tiny ones.
    """
    rows = rows.withColumn("ts_day", F.to_date("ts"))
    rows.hint("rebalance", "ts_day", "node_id").write.mode(mode).partitionBy("ts_day", "node_id").parquet(path)


def append_iceberg(rows: DataFrame, table: str) -> None:
    """The same append where an Iceberg catalog is configured; creates the table if missing."""
    spark = rows.sparkSession
    rows = rows.drop("ts_day")
    if spark.catalog.tableExists(table):
        rows.writeTo(table).append()
    else:
        rows.writeTo(table).using("iceberg").partitionedBy(F.partitioning.days("ts"), "node_id").create()


def write_samples(samples: DataFrame, path: str, *, mode: str = "append") -> None:
    """Samples by day, sorted by (name, series, time) so that name and time bounds skip row groups."""
    daily = samples.withColumn("ts_day", F.to_date("ts"))
    spread = daily.repartitionByRange("ts_day", "name", "series_id", "ts")
    spread.sortWithinPartitions("ts_day", "name", "series_id", "ts").write.mode(mode).partitionBy("ts_day").parquet(path)


def _by_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn(DAY, F.to_date(F.timestamp_seconds("start")))


def _merged(store: Snapshots, at: Snapshot, table: str, parts: DataFrame, days: list[str], width_s: int) -> DataFrame:
    """Bucket parts of some days: those stored and the new ones, a bucket that both have as one row."""
    old = store.read(table, at, days)
    if old is not None:
        parts = coarser_parts(old.select(*parts.columns).unionByName(parts), width_s)
    return _by_day(parts).repartitionByRange(DAY, "name", "series_id", "start").sortWithinPartitions(DAY, "name", "series_id", "start")


def append_tiers(samples: DataFrame, path: str, *, call: int | None = None, writer: str = "") -> dict[str, DataFrame]:
    """Add samples to the raw, minute and hour tiers below ``path`` and return their tables.

    Calls follow the order of arrival.  A second that a series has stored in an
    earlier call is not stored again; a bucket that several calls feed is one
    row; the hours are made from the new samples and the stored hours, never
    from the minutes, which may be pruned by then.  A call reads and writes the
    days of its own samples only, besides one row per series and the index rows
    of new series.  Minute buckets are written with sums and counts; the samples
    are read for raw and minutes.

    A call is one snapshot: readers see all of it or nothing.  ``call`` numbers
    the calls of a writer; one that is committed already changes nothing, so a
    scheduler may repeat a call that it does not know to have succeeded.
    Without a number the call is the writer's next one.
    """
    spark = samples.sparkSession
    store = Snapshots(spark, path)
    base = store.latest()
    call = base.calls.get(writer, 0) + 1 if call is None else call
    if call <= base.calls.get(writer, 0):
        return read_tiers(spark, path)
    part = store.new_part(call)
    newest = store.read("newest", base)

    points = store_points(samples, newest=newest).withColumn(DAY, F.to_date("ts"))
    order = [DAY, "name", "series_id", "ts"]
    store.write("raw", points.repartitionByRange(*order).sortWithinPartitions(*order), part, DAY)
    fresh = f"{path}/_fresh/{part}"
    bucket_parts(samples, MINUTE_S).write.parquet(fresh)
    minutes = spark.read.parquet(fresh)
    days = [str(r[0]) for r in minutes.select(F.to_date(F.timestamp_seconds("start"))).distinct().collect()]  # one row a day
    new = base.with_rows("raw", points.schema, store.written_days("raw", part, days), part, instead=False)
    for table, rows, width_s in (("minute", minutes, MINUTE_S), ("hour", coarser_parts(minutes, HOUR_S), HOUR_S)):
        merged = _merged(store, base, table, rows, days, width_s)
        store.write(table, merged, part, DAY)
        new = new.with_rows(table, merged.schema, store.written_days(table, part, days), part, instead=True)

    seen = samples.groupBy("name", "series_id").agg(F.max("sec").alias("sec"))
    series = seen.select("name", "series_id")
    if newest is not None:
        series = series.join(newest.select("name", "series_id"), ["name", "series_id"], "left_anti")
        seen = seen.unionByName(newest).groupBy("name", "series_id").agg(F.max("sec").alias("sec"))
    index = index_rows(series).sort("name", "key", "value")
    store.write("series", index, part)
    new = new.with_rows("series", index.schema, [""], part, instead=False)
    # what is stored last of a series is what was seen last: a second that exceeds all before it is always stored
    store.write("newest", seen, part)
    new = new.with_rows("newest", seen.schema, [""], part, instead=True)
    new = _existing(store, new, part)
    store.commit(base, new, call, writer)
    files, where = place(spark, fresh)
    files.delete(where, True)
    return read_tiers(spark, path)


def _existing(store: Snapshots, new: Snapshot, part: str) -> Snapshot:
    """Without folders that a call had no rows for."""
    live = dict(new.live)
    for table in ("series", "newest"):
        files, where = place(store.spark, f"{store.path}/{table}/{PART}={part}")
        if not files.exists(where):
            live[table] = {"": [p for p in live[table][""] if p != part]}
    return replace(new, live=live)


def stream_tiers(path: str):
    """A ``foreachBatch`` function that adds each micro-batch to the tiers; the batch number is the number of the call.

    The writer is the query, so a batch that is run again after a failure is one
    call all the same, and a query with a new checkpoint goes on in the same folder.
    """
    def consume(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        append_tiers(batch, path, call=batch_id + 1, writer=query)

    return consume


def compact_tiers(spark: SparkSession, path: str, writer: str = "compaction") -> int:
    """Rewrite days whose raw points lie in several folders, and the index, into one folder each; how many days.

    A snapshot of its own: readers see the same rows before and after.
    """
    store = Snapshots(spark, path)
    base = store.latest()
    days = sorted(d for d, parts in base.live.get("raw", {}).items() if len(parts) > 1)
    call = base.calls.get(writer, 0) + 1
    part = store.new_part(call)
    new = base
    if days:
        order = [DAY, "name", "series_id", "ts"]
        points = store.read("raw", base, days)
        store.write("raw", points.repartitionByRange(*order).sortWithinPartitions(*order), part, DAY)
        new = new.with_rows("raw", points.schema, days, part, instead=True)
    if len(base.live.get("series", {}).get("", [])) > 1:
        index = store.read("series", base).sort("name", "key", "value")
        store.write("series", index, part)
        new = new.with_rows("series", index.schema, [""], part, instead=True)
    if new is not base:
        store.commit(base, new, call, writer)
    return len(days)


def read_tiers(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of ``append_tiers`` as of the newest snapshot, and ``series``, the index of all series.

    The newest bucket of each series is still open and withheld.  It is known
    from one row per series, so bounds on name, day and time reach the scans.
    """
    store = Snapshots(spark, path)
    at = store.latest()
    newest = store.read("newest", at)

    def closed(table: str, width_s: int) -> DataFrame:
        last = newest.select("name", "series_id", floor_to(F.col("sec"), width_s).alias("_open"))
        done = store.read(table, at).join(last, ["name", "series_id"]).where(F.col("start") < F.col("_open"))
        return rollup_of(done, day=True)

    return {"raw": store.read("raw", at), "minute": closed("minute", MINUTE_S), "hour": closed("hour", HOUR_S), "series": store.read("series", at)}


def append_lake(rows: DataFrame, path: str, *, call: int | None = None, writer: str = "") -> None:
    """Export rows as one snapshot of a lake table under ``ts_day=/node_id=``; a call made already changes nothing."""
    store = Snapshots(rows.sparkSession, path)
    base = store.latest()
    call = base.calls.get(writer, 0) + 1 if call is None else call
    if call <= base.calls.get(writer, 0):
        return
    part = store.new_part(call)
    rows = rows.withColumn(DAY, F.to_date("ts"))
    store.write("rows", rows.hint("rebalance", DAY, "node_id"), part, DAY, "node_id")
    files, where = place(rows.sparkSession, f"{path}/rows")
    found = {s.getPath().getParent().getParent().getName().removeprefix(f"{DAY}=") for s in files.globStatus(place(rows.sparkSession, f"{path}/rows/*/*/{PART}={part}")[1]) or []}
    store.commit(base, base.with_rows("rows", rows.schema, sorted(found), part, instead=False), call, writer)


def read_lake(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed calls; day and node still prune folders."""
    return Snapshots(spark, path).read("rows", keys=1)
