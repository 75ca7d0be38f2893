"""Normal form, stored points, rollups, retention, sizes."""

from pyspark.sql import functions as F

from sparktide.operators.rollup import bucket_parts, coarser_parts, rollup, rollup_of, zip_subseries
from sparktide.operators.store import dedup_ordered, retention, ring_retention, sizing_of, sizing_report
from sparktide.plans.tiers import indexed_range, query_range
from sparktide.schema import union_sources
from sparktide.sinks.lake import append_tiers, compact_tiers, read_tiers
from sparktide.sinks.snapshots import Snapshots
from workload.inputs import EV, MI, PT, events, folder, lineitem, micros, minutes, orders, points, query, r6, utc



def buckets():
    return ["series_id", micros("bucket"), r6("min"), r6("avg"), r6("max")]


_LI = """li AS (
  SELECT 'extendedprice{linestatus="' || l_linestatus || '",returnflag="' || l_returnflag || '"}' AS series_id,
         epoch_us(l_shipdate) // 1000000 AS sec, l_extendedprice AS value, l_orderkey * 8 + l_linenumber AS seq
  FROM lineitem)"""


@query("normalize_samples", f"""WITH {EV}
SELECT name, series_id, us AS ts_us, sec, value, 1.0::DOUBLE AS interval_s, false AS anomalous, seq FROM ev""")
def normalize_samples(spark, sf):
    return events(spark, sf).select("name", "series_id", micros("ts"), "sec", "value", "interval_s", "anomalous", "seq")


@query("union_sources", f"""WITH {EV}
SELECT series_id, us AS ts_us, value FROM ev
UNION ALL SELECT 'totalprice{{priority="' || o_orderpriority || '"}}', epoch_us(o_orderdate), o_totalprice FROM orders
UNION ALL SELECT 'extendedprice{{linestatus="' || l_linestatus || '",returnflag="' || l_returnflag || '"}}',
  epoch_us(l_shipdate), l_extendedprice FROM lineitem""")
def union(spark, sf):
    every = union_sources(events(spark, sf), orders(spark, sf), lineitem(spark, sf))
    return every.select("series_id", micros("ts"), "value")


def _rollup_sql(width, closed=False):
    keep = "WHERE bucket_us < newest" if closed else ""
    return f"""WITH {EV} SELECT series_id, bucket_us, round(mn, 6) AS min, round(av, 6) AS avg, round(mx, 6) AS max FROM (
  SELECT *, max(bucket_us) OVER (PARTITION BY series_id) AS newest FROM (
    SELECT series_id, (sec - sec % {width}) * 1000000 AS bucket_us, min(value) AS mn, avg(value) AS av, max(value) AS mx
    FROM ev GROUP BY series_id, sec - sec % {width})) {keep}"""


@query("rollup_minute", _rollup_sql(60))
def rollup_minute(spark, sf):
    return rollup(events(spark, sf), 60).select(*buckets())


@query("rollup_hour", _rollup_sql(3600))
def rollup_hour(spark, sf):
    return rollup(events(spark, sf), 3600).select(*buckets())


@query("rollup_closed", _rollup_sql(3600, closed=True))
def rollup_closed(spark, sf):
    return rollup(events(spark, sf), 3600, closed_only=True).select(*buckets())


@query("rollup_hour_from_minutes", _rollup_sql(3600))
def rollup_from_minutes(spark, sf):
    """Hours made from minute sums and counts instead of the samples."""
    return rollup_of(coarser_parts(bucket_parts(events(spark, sf), 60), 3600)).select(*buckets())


_TIERS: dict[tuple[str, str], str] = {}


def stored_tiers(spark, sf):
    """The three tiers as tables, fed in two calls that overlap in time; built once per application and input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TIERS:
        path = folder(spark, "tiers")
        rows = events(spark, sf)
        half = rows.agg((F.max("seq") / 2).cast("long")).first()[0]
        append_tiers(rows.where(F.col("seq") <= half), path)
        append_tiers(rows.where(F.col("seq") > half), path)
        _TIERS[key] = path
    return read_tiers(spark, _TIERS[key])


TIERS_SQL = f"""WITH {PT}, t AS (
  SELECT 'minute' AS tier, series_id, (sec - sec % 60) * 1000000 AS us, value FROM ev
  UNION ALL SELECT 'hour', series_id, (sec - sec % 3600) * 1000000, value FROM ev),
n AS (SELECT series_id, max(sec) AS newest FROM ev GROUP BY 1)
SELECT tier, series_id, us AS bucket_us, round(min(value), 6) AS min, round(avg(value), 6) AS avg, round(max(value), 6) AS max
FROM t JOIN n USING (series_id)
WHERE us < (CASE tier WHEN 'minute' THEN newest - newest % 60 ELSE newest - newest % 3600 END) * 1000000
GROUP BY tier, series_id, us
UNION ALL SELECT 'raw', series_id, sec * 1000000, round(value, 6), round(value, 6), round(value, 6) FROM pt"""


def tier_rows(made):
    """All tiers as rows of one shape."""
    raw = made["raw"].select(F.lit("raw").alias("tier"), "series_id", micros("ts", "bucket_us"), r6("value", "min"), r6("value", "avg"), r6("value", "max"))
    found = [made[tier].select(F.lit(tier).alias("tier"), *buckets()) for tier in ("minute", "hour")]
    return found[0].unionByName(found[1]).unionByName(raw)


@query("append_tiers", TIERS_SQL)
def tiers(spark, sf):
    """All tiers after two appending calls, made for this query, the second of them repeated."""
    path = folder(spark, "tiers")
    rows = events(spark, sf)
    half = rows.agg((F.max("seq") / 2).cast("long")).first()[0]
    append_tiers(rows.where(F.col("seq") <= half), path, call=1)
    for _ in range(2):
        append_tiers(rows.where(F.col("seq") > half), path, call=2)
    return tier_rows(read_tiers(spark, path))


@query("compact_tiers", TIERS_SQL)
def compacted(spark, sf):
    """All tiers after the folders of three calls were made one a day, and the old ones deleted."""
    path = folder(spark, "tiers")
    rows = events(spark, sf)
    third = rows.agg((F.max("seq") / 3 + 1).cast("long")).first()[0]
    for k in range(3):
        append_tiers(rows.where((F.col("seq") >= third * k) & (F.col("seq") < third * (k + 1))), path)
    compact_tiers(spark, path)
    Snapshots(spark, path).vacuum(1)
    return tier_rows(read_tiers(spark, path))


@query("rollup_hour_lineitem", f"""WITH {_LI}
SELECT series_id, (sec - sec % 3600) * 1000000 AS bucket_us, min(value) AS min, round(avg(value) + 1e-7::DOUBLE, 6) AS avg,
       max(value) AS max FROM li GROUP BY series_id, sec - sec % 3600""")
def rollup_hour_lineitem(spark, sf):
    out = rollup(lineitem(spark, sf), 3600)
    # the shift keeps averages that end in an exact half from rounding either way
    return out.select("series_id", micros("bucket"), "min", F.round(F.col("avg") + 1e-7, 6).alias("avg"), "max")


@query("zip_subseries", f"""WITH {MI} SELECT series_id, bucket_s * 1000000 AS bucket_us, round(mn, 6) AS min,
  round(av, 6) AS avg, round(mx, 6) AS max FROM mi""")
def zipped(spark, sf):
    """Rollup values sent as three series each and put together again."""
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("min", "avg", "max")]))
    long = minutes(spark, sf).withColumn("v", value).select(
        F.concat("name", F.lit("#"), "v.kind").alias("name"), "labels", F.col("bucket").alias("ts"), F.col("v.value").alias("value")
    )
    from sparktide.functions.labels import series_id
    wide = zip_subseries(long)
    return wide.withColumn("series_id", series_id(F.col("name"), F.col("labels"))).select(*buckets())


@query("dedup_ordered", f"""WITH {_LI} SELECT series_id, sec, value, seq FROM (
  SELECT *, max(sec) OVER (PARTITION BY series_id ORDER BY seq, sec, value
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM li) WHERE seen IS NULL OR sec > seen""")
def dedup(spark, sf):
    return dedup_ordered(lineitem(spark, sf)).select("series_id", "sec", "value", "seq")


@query("store_points", f"WITH {PT} SELECT series_id, sec * 1000000 AS ts_us, value FROM pt")
def stored(spark, sf):
    return points(spark, sf).select("series_id", micros("ts"), "value")


@query("ring_retention", f"""WITH {PT}, ch AS (SELECT *, sec // 21600 AS n FROM pt),
kept AS (SELECT series_id, max(n) AS n FROM ch GROUP BY series_id, n % 8)
SELECT ch.series_id, sec * 1000000 AS ts_us, value FROM ch JOIN kept ON ch.series_id = kept.series_id AND ch.n = kept.n""")
def ring(spark, sf):
    """Two days at one sample a second: chunks of six hours."""
    return ring_retention(stored_tiers(spark, sf)["raw"], 2 * 86400).select("series_id", micros("ts"), "value")


@query("retention", f"""WITH {PT} SELECT series_id, sec * 1000000 AS ts_us, value FROM (
  SELECT *, max(sec) OVER (PARTITION BY series_id) AS newest FROM pt) WHERE sec > newest - 604800""")
def kept(spark, sf):
    return retention(stored_tiers(spark, sf)["raw"], 7 * 86400).select("series_id", micros("ts"), "value")


_SIZES = f"""WITH {EV}, t AS (
  SELECT 'raw' AS tier, 1 AS sub, 480.0::DOUBLE AS plan, count(*) AS n, count(DISTINCT series_id) AS s FROM ev
  UNION ALL SELECT 'minute', 3, 10080.0, count(*), count(DISTINCT series_id)
    FROM (SELECT DISTINCT series_id, sec // 60 FROM ev)
  UNION ALL SELECT 'hour', 3, 8760.0, count(*), count(DISTINCT series_id)
    FROM (SELECT DISTINCT series_id, sec // 3600 FROM ev))
SELECT tier, CAST(s AS BIGINT) AS series, CAST(n * sub AS BIGINT) AS points, CAST(n * sub * 16 AS BIGINT) AS bytes,
  plan AS planned_points_per_series, s * sub * 16 * plan AS planned_bytes,
  round(s * sub * 16 * plan / 3.14::DOUBLE, 4) AS planned_compressed_bytes FROM t"""


@query("sizing_report", _SIZES)
def sizes(spark, sf):
    return sizing_of(events(spark, sf)).withColumn("planned_compressed_bytes", F.round("planned_compressed_bytes", 4))


@query("sizing_report_tables", _SIZES)
def sizes_of_tables(spark, sf):
    """The same from three tables that are there."""
    raw = events(spark, sf)
    return sizing_report(raw, rollup(raw, 60), rollup(raw, 3600)).withColumn(
        "planned_compressed_bytes", F.round("planned_compressed_bytes", 4)
    )


_FROM, _TO = utc(2024, 1, 5), utc(2024, 1, 12)
_SPAN = "BETWEEN epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(TIMESTAMP '2024-01-12')"


@query("query_range", f"""WITH {PT} SELECT series_id, sec * 1000000 AS ts_us, value FROM pt
WHERE name = 'click' AND shard = '1' AND sec * 1000000 {_SPAN}""")
def range_raw(spark, sf):
    found = query_range(stored_tiers(spark, sf), "click", {"shard": "1"}, _FROM, _TO)
    return found.select("series_id", micros("ts"), "value")


@query("query_range_minute", f"""WITH {MI} SELECT series_id, bucket_s * 1000000 AS bucket_us, round(mn, 6) AS min,
  round(av, 6) AS avg, round(mx, 6) AS max FROM mi WHERE name = 'view' AND bucket_s * 1000000 {_SPAN}""")
def range_minute(spark, sf):
    found = query_range(stored_tiers(spark, sf), "view", {}, _FROM, _TO, "minute")
    return found.select(*buckets())


@query("query_range_hour", f"""WITH {EV}, h AS (
  SELECT name, shard, series_id, (sec - sec % 3600) * 1000000 AS bucket_us, min(value) AS mn, avg(value) AS av, max(value) AS mx
  FROM ev GROUP BY name, shard, series_id, sec - sec % 3600)
SELECT series_id, bucket_us, round(mn, 6) AS min, round(av, 6) AS avg, round(mx, 6) AS max FROM h
WHERE name = 'click' AND shard = '3' AND bucket_us {_SPAN}""")
def range_hour(spark, sf):
    found = query_range(stored_tiers(spark, sf), "click", "shard=3", _FROM, _TO, "hour")
    return found.select(*buckets())


@query("indexed_range", f"""WITH {PT} SELECT series_id, sec * 1000000 AS ts_us, value FROM pt
WHERE name = 'view' AND shard = '2' AND sec * 1000000 {_SPAN}""")
def range_indexed(spark, sf):
    """The main query with the series looked up in the index."""
    found = indexed_range(stored_tiers(spark, sf), "view", "shard=2", _FROM, _TO)
    return found.select("series_id", micros("ts"), "value")
