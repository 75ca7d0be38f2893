"""Rates, percentages and joins of series."""

from pyspark.sql import functions as F

from sparktide.functions.labels import label, series_id
from sparktide.operators import derive as D
from sparktide.operators.rollup import rollup
from sparktide.sources.tables import samples_from_table
from workload.inputs import CO, EV, PT, counters, events, micros, points, query, r6, shard, table

_RATE = """rt AS (SELECT name, shard, series_id, sec, (value - pv) / (sec - ps) AS rate FROM (
  SELECT *, lag(value) OVER w AS pv, lag(sec) OVER w AS ps FROM pt WINDOW w AS (PARTITION BY series_id ORDER BY sec))
  WHERE sec > ps AND value >= pv)"""


@query("counter_rate", f"WITH {PT}, {_RATE} SELECT series_id, sec * 1000000 AS ts_us, round(rate + 1e-8::DOUBLE, 6) AS rate FROM rt")
def rates(spark, sf):
    # the shift keeps rates that end in an exact half from rounding either way
    return D.counter_rate(points(spark, sf)).select("series_id", micros("ts"), r6(F.col("rate") + 1e-8, "rate"))


@query("rate_sum", f"WITH {PT}, {_RATE} SELECT sec * 1000000 AS ts_us, round(sum(rate) + 1e-8::DOUBLE, 6) AS rate FROM rt GROUP BY sec")
def summed(spark, sf):
    return D.rate_sum(points(spark, sf)).select(micros("ts"), r6(F.col("rate") + 1e-8, "rate"))


@query("rate_sum_where", """WITH rq AS (
  SELECT CASE user_id % 3 WHEN 0 THEN '200' WHEN 1 THEN '500' ELSE '503' END AS status, epoch_us(ts) AS us,
         CAST(event_id AS DOUBLE) AS value FROM events),
rt AS (SELECT us, (value - lag(value) OVER w) / ((us - lag(us) OVER w) / 1e6::DOUBLE) AS rate, status FROM rq
  WINDOW w AS (PARTITION BY status ORDER BY us))
SELECT us AS ts_us, round(rate, 6) AS rate FROM rt WHERE status LIKE '5%' AND rate IS NOT NULL""")
def errors(spark, sf):
    """Rate of the requests whose status label is of the 5xx class."""
    k = F.col("user_id") % 3
    rows = samples_from_table(
        table(spark, sf, "events"), name="http_requests_total", ts="ts", value=F.col("event_id").cast("double"),
        labels={"status": F.when(k == 0, F.lit("200")).when(k == 1, F.lit("500")).otherwise(F.lit("503"))}, seq="event_id",
    )
    return D.rate_sum(rows, "http_requests_total", D.server_errors()).select(micros("ts"), r6("rate"))


@query("cpu_busy_percent", f"""WITH {CO} SELECT us AS ts_us, round(greatest(0, least(100, 100 - avg(rate) * 100)), 6) AS busy
FROM ra WHERE name = 'node_cpu_seconds_total' GROUP BY us""")
def busy(spark, sf):
    return D.cpu_busy_percent(counters(spark, sf)).select(micros("ts"), r6("busy"))


@query("cpu_busy_per_cpu", f"""WITH {CO} SELECT shard AS cpu, us AS ts_us,
  round(greatest(0, least(100, 100 - avg(rate) * 100)), 6) AS busy
FROM ra WHERE name = 'node_cpu_seconds_total' GROUP BY shard, us""")
def busy_per_cpu(spark, sf):
    return D.cpu_busy_percent(counters(spark, sf), per_cpu=True).select("cpu", micros("ts"), r6("busy"))


@query("cpu_busy_gauge", """SELECT epoch_us(ts) AS ts_us, round(100 - value, 6) AS busy FROM events WHERE event_type = 'view'""")
def gauge(spark, sf):
    mode = F.when(F.col("event_type") == "view", F.lit("idle")).otherwise(F.lit("user"))
    rows = samples_from_table(
        table(spark, sf, "events"), name="node_cpu_usage_percent", ts="ts", value="value", labels={"mode": mode}, seq="event_id"
    )
    return D.cpu_busy_gauge(rows).select(micros("ts"), r6("busy"))


@query("primary_network_rate", f"""WITH {CO} SELECT us AS ts_us,
  round(sum(CASE WHEN name = 'node_network_receive_bytes_total' THEN rate END), 6) AS rx,
  round(sum(CASE WHEN name = 'node_network_transmit_bytes_total' THEN rate END), 6) AS tx
FROM ra WHERE name LIKE 'node_network%bytes_total' AND shard IN (SELECT shard FROM co WHERE name = 'node_network_primary_info')
GROUP BY us""")
def network(spark, sf):
    """The labels of the primary interface, here with a processor, tell its host as well."""
    return D.primary_network_rate(counters(spark, sf)).select(micros("ts"), r6("rx"), r6("tx"))


@query("rates_by_time", f"""WITH {CO} SELECT us AS ts_us,
  round(sum(CASE WHEN name = 'node_disk_read_bytes_total' THEN rate END), 6) AS read,
  round(sum(CASE WHEN name = 'node_network_receive_bytes_total' THEN rate END), 6) AS received
FROM ra WHERE name IN ('node_disk_read_bytes_total', 'node_network_receive_bytes_total') GROUP BY us""")
def by_time(spark, sf):
    names = {"node_disk_read_bytes_total": "read", "node_network_receive_bytes_total": "received"}
    return D.rates_by_time(counters(spark, sf), names).select(micros("ts"), r6("read"), r6("received"))


def _hourly(spark, sf, name=None):
    hours = rollup(events(spark, sf), 3600)
    out = hours.select("name", "labels", F.col("bucket").alias("ts"), F.col("avg").alias("value"))
    return out if name is None else out.where(F.col("name") == name)


_HOURS = f"""{EV}, ho AS (SELECT name, shard, (sec - sec % 3600) * 1000000 AS us, avg(value) AS value
  FROM ev GROUP BY name, shard, sec - sec % 3600)"""


@query("used_percent", f"""WITH {_HOURS} SELECT a.shard, a.us AS ts_us,
  round(greatest(0, least(100, 100 * (1 - b.value / a.value))), 6) AS used
FROM ho a JOIN ho b ON a.shard = b.shard AND a.us = b.us WHERE a.name = 'click' AND b.name = 'view'""")
def used(spark, sf):
    """Four instances that report at equal times, paired by their labels."""
    def side(name):
        return _hourly(spark, sf, name).withColumn("series_id", series_id(F.col("name"), F.col("labels")))

    found = D.used_percent(side("click"), side("view"))
    return found.select(label(F.col("labels"), "shard").alias("shard"), micros("ts"), r6("used"))


@query("memory_used_percent", f"""WITH {_HOURS} SELECT a.shard AS instance, a.us AS ts_us,
  round(greatest(0, least(100, 100 * (1 - b.value / a.value))), 6) AS used
FROM ho a JOIN ho b ON a.shard = b.shard AND a.us = b.us
WHERE (a.name = 'click' AND b.name = 'view') OR (a.name = 'purchase' AND b.name = 'signup')""")
def memory(spark, sf):
    """Event types standing in for the Linux pair and the macOS pair of memory gauges."""
    kind = F.create_map(*[F.lit(x) for x in (
        "click", "MemTotal", "view", "MemAvailable", "purchase", "total", "signup", "free")])
    rows = _hourly(spark, sf).select(
        F.concat(F.lit("node_memory_"), F.try_element_at(kind, F.col("name")), F.lit("_bytes")).alias("name"),
        F.create_map(F.lit("instance"), label(F.col("labels"), "shard")).alias("labels"), "ts", "value",
    ).withColumn("series_id", series_id(F.col("name"), F.col("labels")))
    return D.memory_used_percent(rows).select(label(F.col("labels"), "instance").alias("instance"), micros("ts"), r6("used"))


@query("filesystem_used_percent", f"""WITH {_HOURS} SELECT '/data' || a.shard AS mountpoint, a.us AS ts_us,
  round(greatest(0, least(100, 100 * (1 - b.value / a.value))), 6) AS used
FROM ho a JOIN ho b ON a.shard = b.shard AND a.us = b.us WHERE a.name = 'click' AND b.name = 'view'""")
def filesystem(spark, sf):
    rows = _hourly(spark, sf).where(F.col("name").isin("click", "view")).select(
        F.when(F.col("name") == "click", F.lit("node_filesystem_size_bytes")).otherwise(
            F.lit("node_filesystem_avail_bytes")).alias("name"),
        F.create_map(F.lit("mountpoint"), F.concat(F.lit("/data"), label(F.col("labels"), "shard"))).alias("labels"),
        "ts", "value",
    ).withColumn("series_id", series_id(F.col("name"), F.col("labels")))
    return D.filesystem_used_percent(rows).select(label(F.col("labels"), "mountpoint").alias("mountpoint"), micros("ts"), r6("used"))


@query("align_series", f"""WITH {EV} SELECT (sec - sec % 3600) * 1000000 AS ts_us,
  max(CASE WHEN shard = '0' THEN a END) AS s0, max(CASE WHEN shard = '1' THEN a END) AS s1,
  max(CASE WHEN shard = '2' THEN a END) AS s2, max(CASE WHEN shard = '3' THEN a END) AS s3
FROM (SELECT shard, sec - sec % 3600 AS sec, round(avg(value), 6) AS a FROM ev WHERE name = 'click' GROUP BY 1, 2)
GROUP BY sec""")
def aligned(spark, sf):
    rows = _hourly(spark, sf, "click").withColumn("shard", label(F.col("labels"), "shard"))
    rows = rows.withColumn("series_id", series_id(F.col("name"), F.col("labels")))
    wide = D.align_series(rows.withColumn("value", F.round("value", 6)), "shard", ["0", "1", "2", "3"])
    return wide.select(micros("ts"), *[F.col(k).alias(f"s{k}") for k in "0123"])


@query("align_points", f"""WITH {EV} SELECT us AS ts_us, CAST(floor(value) AS INTEGER) AS level, series_id, value FROM ev""")
def aligned_long(spark, sf):
    """Events on one time axis by their whole value: many columns, and series that share one."""
    rows = events(spark, sf).withColumn("level", F.floor("value").cast("int"))
    return D.align_points(rows, "level", order="numeric").select(micros("ts"), "level", "series_id", "value")


@query("avg_latency_ms", """WITH c AS (SELECT CAST(user_id % 4 AS VARCHAR) AS shard, epoch_us(ts) AS us,
  CAST(event_id AS DOUBLE) AS n, event_id * 0.25::DOUBLE + (epoch_us(ts) // 1000000) * 0.001::DOUBLE AS v FROM events),
r AS (SELECT us, (n - lag(n) OVER w) / ((us - lag(us) OVER w) / 1e6::DOUBLE) AS rn,
  (v - lag(v) OVER w) / ((us - lag(us) OVER w) / 1e6::DOUBLE) AS rv FROM c WINDOW w AS (PARTITION BY shard ORDER BY us))
SELECT us AS ts_us, round(1000 * sum(rv) / sum(rn), 4) AS avg_ms FROM r WHERE rn IS NOT NULL GROUP BY us HAVING sum(rn) > 0""")
def latency(spark, sf):
    """The two counters of a duration histogram, each summed over its series."""
    rows = table(spark, sf, "events")
    count = F.col("event_id").cast("double")
    total = F.col("event_id") * 0.25 + F.unix_seconds(F.col("ts").cast("timestamp")) * 0.001

    def side(name, value):
        return samples_from_table(rows, name=name, ts="ts", value=value, labels={"shard": shard()}, seq="event_id")

    out = D.avg_latency_ms(side("d_sum", total), side("d_count", count))
    return out.select(micros("ts"), F.round("avg_ms", 4).alias("avg_ms"))


@query("red_summary", """SELECT CAST(user_id % 4 AS VARCHAR) AS shard, event_type, count(*) AS requests,
  CAST(count_if(value > 100) AS BIGINT) AS errors, round(sum(value / 100), 6) AS duration_sum, count(value) AS duration_count,
  """ + ", ".join(f"CAST(count_if(value / 100 <= {b}::DOUBLE) AS BIGINT) AS le_{f'{b:g}'.replace('.', '_')}" for b in D.DURATION_BOUNDS) + """,
  count(value) AS le_inf FROM events GROUP BY 1, 2""")
def red(spark, sf):
    rows = table(spark, sf, "events").withColumn("duration", F.col("value") / 100).withColumn("shard", shard().cast("string"))
    out = D.red_summary(rows, ["shard", "event_type"], "duration", F.col("value") > 100)
    return out.withColumn("duration_sum", F.round("duration_sum", 6))


@query("flatten_cumulative", """WITH f AS (SELECT event_id, event_type, value, user_id,
  CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'gauge' WHEN 'purchase' THEN 'histogram'
       WHEN 'signup' THEN 'summary' ELSE 'untyped' END AS type FROM events)
SELECT event_id AS id, event_type AS name, value, type = 'counter' AS cumulative FROM f WHERE type NOT IN ('histogram', 'summary')
UNION ALL SELECT event_id, event_type || '_sum', value, true FROM f WHERE type IN ('histogram', 'summary')
UNION ALL SELECT event_id, event_type || '_count', CAST(user_id AS DOUBLE), true FROM f WHERE type IN ('histogram', 'summary')""")
def flattened(spark, sf):
    kind = F.create_map(*[F.lit(x) for x in (
        "click", "counter", "view", "gauge", "purchase", "histogram", "signup", "summary", "error", "untyped")])
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.try_element_at(kind, F.col("event_type")).alias("type"),
        F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("labels"), "value",
        F.col("value").alias("sum"), F.col("user_id").cast("double").alias("count"),
    )
    out = D.flatten_cumulative(rows)
    return out.select(label(F.col("labels"), "id").cast("long").alias("id"), "name", "value", "cumulative")
