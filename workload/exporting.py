"""Export rows, the lake table, matrix and text outputs."""

from pyspark.sql import functions as F

from sparktide.operators.export import delta_since, delta_watermark, federated_query, lake_rows, local_source
from sparktide.operators.rollup import rollup
from sparktide.operators.select import latest_per_series
from sparktide.plans.tiers import query_range
from sparktide.sinks.lake import append_lake, read_lake, write_lake, write_samples
from sparktide.sinks.matrix import matrix_query, matrix_result, timeseries_batches
from sparktide.sinks.text import render_exposition
from sparktide.sources.delta_json import parse_delta_json
from workload.storing import stored_tiers
from workload.inputs import EV, MI, PT, events, folder, from_events, micros, minutes, points, query, r6, table, utc



def lake_columns():
    return ["node_id", "hostname", "metric_name", "labels_json", micros("ts"), r6("value"), "anomaly_bit"]


_SINCE = utc(2024, 1, 10)


@query("delta_since", f"""WITH {MI} SELECT 'n1' AS node_id, 'host1' AS hostname, name AS metric_name,
  '{{"shard":"' || shard || '"}}' AS labels_json, bucket_s * 1000000 AS ts_us, round(av, 6) AS value, false AS anomaly_bit
FROM mi WHERE bucket_s > epoch(TIMESTAMP '2024-01-10') AND bucket_s <= epoch(TIMESTAMP '2024-01-20')""")
def delta(spark, sf):
    return delta_since(minutes(spark, sf), _SINCE, utc(2024, 1, 20), "n1", "host1").select(*lake_columns())


@query("delta_watermark", f"WITH {MI} SELECT CAST(max(bucket_s) * 1000000 AS BIGINT) AS watermark_us FROM mi WHERE bucket_s > epoch(TIMESTAMP '2024-01-10')")
def watermark(spark, sf):
    rows = delta_since(minutes(spark, sf), _SINCE, None, "n1", "host1")
    return delta_watermark(rows, _SINCE).select(micros("watermark"))


@query("delta_watermark_unchanged", """SELECT epoch_us(TIMESTAMP '2030-01-01') AS watermark_us
FROM (SELECT count_if(ts > TIMESTAMP '2030-01-01') AS n FROM events) WHERE n = 0""")
def watermark_unchanged(spark, sf):
    since = utc(2030, 1, 1)
    return delta_watermark(delta_since(minutes(spark, sf), since, None, "n1", "host1"), since).select(micros("watermark"))


def _node_rows(spark, sf):
    """Minute averages of three nodes."""
    rows = table(spark, sf, "events")
    parts = []
    for n in range(3):
        buckets = rollup(from_events(rows.where(F.col("user_id") % 3 == n)), 60)
        parts.append(lake_rows(buckets, f"node{n}", f"host{n}"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NODES = """nr AS (SELECT 'node' || (user_id % 3) AS node_id, event_type AS name, user_id % 4 AS shard,
  epoch_us(ts) // 60000000 * 60000000 AS us, avg(value) AS av FROM events GROUP BY ALL)"""


def _lake(spark, sf, times=1):
    path = folder(spark, "lake")
    rows = _node_rows(spark, sf)
    for _ in range(times):
        write_lake(rows, path)
    return spark.read.parquet(path)


@query("write_lake", f"""WITH {_NODES} SELECT node_id, 'host' || right(node_id, 1) AS hostname, name AS metric_name,
  '{{"shard":"' || shard || '"}}' AS labels_json, us AS ts_us, round(av, 6) AS value, false AS anomaly_bit FROM nr""")
def lake(spark, sf):
    return _lake(spark, sf).select(*lake_columns())


@query("federated_query", f"""WITH {_NODES} SELECT node_id, name AS metric_name, us AS ts_us, round(av, 6) AS value FROM nr
WHERE node_id IN ('node0', 'node2') AND name = 'click' AND shard = 1
  AND us BETWEEN epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(TIMESTAMP '2024-01-20')""")
def federated(spark, sf):
    found = federated_query(
        _lake(spark, sf), nodes=["node0", "node2"], start=utc(2024, 1, 5), end=utc(2024, 1, 20), metric="click", labels={"shard": "1"}
    )
    return found.select("node_id", "metric_name", micros("ts"), r6("value"))


@query("federated_query_dedupe", f"WITH {_NODES} SELECT node_id, name AS metric_name, shard, us AS ts_us, round(av, 6) AS value FROM nr")
def federated_once(spark, sf):
    """The same rows exported twice and read once."""
    found = federated_query(_lake(spark, sf, times=2), dedupe=True)
    shard = F.regexp_extract("labels_json", '"shard":"(\\d+)"', 1).cast("long").alias("shard")
    return found.select("node_id", "metric_name", shard, micros("ts"), r6("value"))


@query("write_samples", f"""WITH {EV} SELECT series_id, us AS ts_us, value FROM ev WHERE name = 'view'
  AND us BETWEEN epoch_us(TIMESTAMP '2024-01-08') AND epoch_us(TIMESTAMP '2024-01-09 12:00:00')""")
def day_table(spark, sf):
    """A sample table by day, read back through the main query."""
    path = folder(spark, "samples")
    write_samples(events(spark, sf), path)
    found = query_range({"raw": spark.read.parquet(path)}, "view", None, utc(2024, 1, 8), utc(2024, 1, 9, 12))
    return found.select("series_id", micros("ts"), "value")


@query("read_delta_json", """SELECT event_type AS metric_name, '{"shard":"' || (user_id % 4) || '"}' AS labels_json,
  epoch_us(ts) // 1000000 * 1000000 AS ts_us, value, value > 100 AS anomaly_bit FROM events""")
def delta_json(spark, sf):
    """One delta document per event, written as JSON and parsed again."""
    row = F.struct(
        F.lit("n1").alias("node_id"), F.lit("h1").alias("hostname"), F.col("event_type").alias("metric_name"),
        F.create_map(F.lit("shard"), (F.col("user_id") % 4).cast("string")).alias("labels"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), "value", (F.col("value") > 100).alias("anomalous"),
    )
    docs = table(spark, sf, "events").select(F.to_json(F.struct(F.array(row).alias("rows"))).alias("value"))
    return parse_delta_json(docs).select("metric_name", "labels_json", micros("ts"), "value", "anomaly_bit")


def _text(column):
    return rf"regexp_replace(CAST({column} AS VARCHAR), '\.0$', '')"


@query("matrix_result", f"""WITH {PT} SELECT series_id, (sec - epoch(TIMESTAMP '2024-01-05')::BIGINT) // 21600 AS chunk, count(*) AS points,
  '{{"metric":{{"__name__":"click","shard":"' || shard || '"}},"values":['
  || string_agg('[' || sec || ',"' || {_text("value")} || '"]', ',' ORDER BY sec) || ']}}' AS json
FROM pt WHERE name = 'click' AND sec BETWEEN epoch(TIMESTAMP '2024-01-05') AND epoch(TIMESTAMP '2024-01-12')
GROUP BY series_id, shard, (sec - epoch(TIMESTAMP '2024-01-05')::BIGINT) // 21600""")
def matrix(spark, sf):
    start = utc(2024, 1, 5)
    return matrix_query(stored_tiers(spark, sf), "click", None, start, utc(2024, 1, 12))


@query("matrix_query_empty", f"""WITH {PT}, f AS (SELECT series_id, shard, string_agg('[' || sec || ',"' || {_text("value")} || '"]', ',' ORDER BY sec) AS v, count(*) AS points
  FROM pt WHERE name = 'click' AND sec BETWEEN epoch(TIMESTAMP '2024-01-15') AND epoch(TIMESTAMP '2024-01-15 02:00:00') GROUP BY series_id, shard)
SELECT s.series_id, CAST(0 AS BIGINT) AS chunk, coalesce(points, 0) AS points,
  '{{"metric":{{"__name__":"click","shard":"' || s.shard || '"}},"values":[' || coalesce(v, '') || ']}}' AS json
FROM (SELECT DISTINCT series_id, shard FROM pt WHERE name = 'click') s LEFT JOIN f USING (series_id)""")
def matrix_empty(spark, sf):
    """Two hours in which some of the series have no point."""
    return matrix_query(stored_tiers(spark, sf), "click", None, utc(2024, 1, 15), utc(2024, 1, 15, 2))


@query("matrix_result_tier", f"""WITH {MI} SELECT series_id, bucket_s // 86400 AS chunk, count(*) AS points,
  '{{"metric":{{"__name__":"view","shard":"' || shard || '"}},"values":[' || string_agg('[' || bucket_s || ',"' || {_text("floor(av * 4) / 4")} || '"]', ',' ORDER BY bucket_s)
  || '],"min":[' || string_agg('[' || bucket_s || ',"' || {_text("mn")} || '"]', ',' ORDER BY bucket_s)
  || '],"max":[' || string_agg('[' || bucket_s || ',"' || {_text("mx")} || '"]', ',' ORDER BY bucket_s) || ']}}' AS json
FROM mi WHERE name = 'view' GROUP BY series_id, shard, bucket_s // 86400""")
def matrix_tier(spark, sf):
    """Averages in quarters, so that fractional text is compared."""
    found = minutes(spark, sf).where(F.col("name") == "view").withColumn("avg", F.floor(F.col("avg") * 4) / 4)
    return matrix_result(found, chunk_s=86400)


@query("timeseries_batches", f"""WITH {EV} SELECT series_id, (sec - sec % 21600) AS chunk, '__name__=' || name || ',shard=' || shard AS labels,
  count(*) AS n, string_agg(CAST(us // 1000 AS VARCHAR), ',' ORDER BY us // 1000) AS stamps, round(sum(value), 6) AS total
FROM ev GROUP BY series_id, name, shard, sec - sec % 21600""")
def batches(spark, sf):
    out = timeseries_batches(events(spark, sf))
    pairs = F.array_join(F.transform("labels", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select(
        "series_id", "chunk", pairs.alias("labels"), F.size("samples").cast("long").alias("n"),
        F.array_join(F.transform("samples", lambda s: s["ts_ms"].cast("string")), ",").alias("stamps"),
        r6(F.aggregate("samples", F.lit(0.0), lambda a, s: a + s["value"]), "total"),
    )


@query("render_exposition", f"""WITH {EV}, la AS (
  SELECT name, shard, series_id, max(us) AS us, arg_max(value, us) AS value FROM ev GROUP BY name, shard, series_id)
SELECT DISTINCT name, 0 AS part, '# TYPE ' || name || ' untyped' AS line FROM la
UNION ALL SELECT name, 1, name || '{{shard="' || shard || '"}} ' || {_text("value")} || ' ' || (us // 1000) FROM la""")
def exposition(spark, sf):
    return render_exposition(latest_per_series(events(spark, sf))).select("name", "part", "line")


@query("append_lake", f"""WITH {_NODES} SELECT node_id, 'host' || right(node_id, 1) AS hostname, name AS metric_name,
  '{{"shard":"' || shard || '"}}' AS labels_json, us AS ts_us, round(av, 6) AS value, false AS anomaly_bit FROM nr""")
def lake_calls(spark, sf):
    """Each node's rows as a snapshot of the lake table, each call made twice."""
    path = folder(spark, "lake")
    rows = _node_rows(spark, sf)
    for n in range(3):
        for _ in range(2):
            append_lake(rows.where(F.col("node_id") == f"node{n}"), path, call=1, writer=f"node{n}")
    return read_lake(spark, path).select(*lake_columns())


@query("delta_source", f"""WITH {MI} SELECT 'n1' AS node_id, 'host1' AS hostname, name AS metric_name,
  '{{"shard":"' || shard || '"}}' AS labels_json, bucket_s * 1000000 AS ts_us, round(av, 6) AS value, false AS anomaly_bit
FROM mi WHERE bucket_s > epoch(TIMESTAMP '2024-01-10') AND bucket_s <= epoch(TIMESTAMP '2024-01-20')""")
def source(spark, sf):
    """Three pulls from a source, each from the watermark that the one before gave."""
    pull = local_source(minutes(spark, sf), "n1", "host1")
    since, parts = _SINCE, []
    for day in (13, 16, 20):
        parts.append(pull(since, utc(2024, 1, day)))
        since = utc(2024, 1, day)
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*lake_columns())
