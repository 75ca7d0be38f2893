"""The registry and the sample frames the queries start from."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.operators.rollup import rollup
from sparktide.operators.store import store_points
from sparktide.sources.tables import samples_from_table
from sparktide.streaming.paths import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, the SQL."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shard() -> Column:
    return F.col("user_id") % 4


def from_events(events: DataFrame, labels: dict[str, Column] | None = None) -> DataFrame:
    return samples_from_table(
        events, name=F.col("event_type"), ts="ts", value="value", labels=labels or {"shard": shard()}, seq="event_id"
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    """One series per event type and shard."""
    return from_events(table(spark, sf, "events"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """The same as stored: one point per second."""
    return store_points(events(spark, sf))


def label_of_week() -> Column:
    """Number of the week of an event, counted from 1970."""
    return F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 604800000000").cast("string")


def event_file(spark: SparkSession, sf: str, k: int, n: int, path: str) -> None:
    """Add the k-th of n equal stretches of the event table, in order of arrival, to a folder as one file."""
    rows = table(spark, sf, "events")
    total = rows.agg(F.max("event_id") + 1).first()[0]
    rows.where(F.floor(F.col("event_id") * n / F.lit(total)) == k).coalesce(1).write.mode("append").parquet(path)


_FILES: dict[tuple[str, str, int], str] = {}


def event_files(spark: SparkSession, sf: str, n: int = 3) -> str:
    """A folder with the event table in n files, made once per application and input."""
    key = (spark.sparkContext.applicationId, sf, n)
    if key not in _FILES:
        path = folder(spark, "events")
        for k in range(n):
            event_file(spark, sf, k, n, path)
        _FILES[key] = path
    return _FILES[key]


def file_stream(spark: SparkSession, sf: str, path: str, labels: dict[str, Column] | None = None) -> DataFrame:
    """Samples of a folder of event files, one file to a micro-batch."""
    schema = table(spark, sf, "events").schema
    return from_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), labels)


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Six series with many samples per second, arriving in order-key order."""
    rows = table(spark, sf, "lineitem")
    return samples_from_table(
        rows, name="extendedprice", ts="l_shipdate", value="l_extendedprice",
        labels={"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")},
        seq=F.col("l_orderkey") * 8 + F.col("l_linenumber"),
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return samples_from_table(
        table(spark, sf, "orders"), name="totalprice", ts="o_orderdate", value="o_totalprice",
        labels={"priority": F.col("o_orderpriority")}, seq="o_orderkey",
    )


def minutes(spark: SparkSession, sf: str) -> DataFrame:
    return rollup(events(spark, sf), 60, closed_only=True)


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Host-like counters and gauges out of events: idle CPU time, disk, network and memory readings."""
    rows = table(spark, sf, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    name = (
        F.when(F.col("event_type") == "click", F.lit("node_cpu_seconds_total"))
        .when(F.col("event_type") == "view", F.lit("node_disk_read_bytes_total"))
        .when(F.col("event_type") == "purchase", F.lit("node_network_receive_bytes_total"))
        .when(F.col("event_type") == "signup", F.lit("node_network_transmit_bytes_total"))
        .when(shard() == 2, F.lit("node_network_primary_info"))
        .otherwise(F.lit("node_errors_total"))
    )
    labels = {"cpu": shard(), "mode": F.lit("idle"), "device": F.concat(F.lit("eth"), shard().cast("string"))}
    return samples_from_table(
        rows, name=name, ts="ts", value=F.col("sec") * 0.5 + F.col("value") * 4, labels=labels, seq="event_id",
    )


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


def micros(column: str, name: str | None = None) -> Column:
    return F.unix_micros(F.col(column)).alias(name or f"{column}_us")


def r6(column: str | Column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


# SQL forms of the frames above.
EV = """ev AS (
  SELECT event_type AS name, CAST(user_id % 4 AS VARCHAR) AS shard,
         event_type || '{shard="' || CAST(user_id % 4 AS VARCHAR) || '"}' AS series_id,
         epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS sec, value, event_id AS seq, user_id
  FROM events)"""

PT = EV + """, pt AS (
  SELECT * FROM (
    SELECT *, max(sec) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM ev) WHERE seen IS NULL OR sec > seen)"""

MI = EV + """, mi AS (
  SELECT * FROM (
    SELECT name, shard, series_id, bucket_s, mn, av, mx,
           max(bucket_s) OVER (PARTITION BY series_id) AS newest
    FROM (SELECT name, shard, series_id, sec - sec % 60 AS bucket_s, min(value) AS mn, avg(value) AS av, max(value) AS mx
          FROM ev GROUP BY name, shard, series_id, sec - sec % 60)) WHERE bucket_s < newest)"""

CO = """co AS (
  SELECT CASE event_type WHEN 'click' THEN 'node_cpu_seconds_total' WHEN 'view' THEN 'node_disk_read_bytes_total'
              WHEN 'purchase' THEN 'node_network_receive_bytes_total'
              WHEN 'signup' THEN 'node_network_transmit_bytes_total'
              ELSE CASE WHEN user_id % 4 = 2 THEN 'node_network_primary_info' ELSE 'node_errors_total' END END AS name,
         CAST(user_id % 4 AS VARCHAR) AS shard, epoch_us(ts) AS us,
         (epoch_us(ts) // 1000000) * 0.5::DOUBLE + value * 4 AS value
  FROM events),
ra AS (
  SELECT name, shard, us, (value - pv) / ((us - pu) / 1e6::DOUBLE) AS rate FROM (
    SELECT *, lag(value) OVER w AS pv, lag(us) OVER w AS pu FROM co WINDOW w AS (PARTITION BY name, shard ORDER BY us))
  WHERE us > pu AND value >= pv)"""
