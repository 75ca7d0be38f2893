"""Filters, catalogue, latest values."""

from pyspark.sql import functions as F

from sparktide.functions.labels import label, label_match, metric_labels
from sparktide.functions.numbers import OPERATORS, compare_op
from sparktide.operators.select import (
    last_n, latest_per_series, latest_sum, list_metrics, list_series, select_series, time_range,
)
from sparktide.operators.index import find_series, indexed_metrics, indexed_series
from sparktide.plans.tiers import auto_tier, empty_series, query_range
from sparktide.operators.rollup import rollup
from workload.storing import stored_tiers
from workload.inputs import EV, PT, events, lineitem, micros, points, query, r6, utc


@query("select_series", f"WITH {EV} SELECT series_id, us AS ts_us, value FROM ev WHERE name = 'purchase'")
def by_name(spark, sf):
    return select_series(events(spark, sf), "purchase").select("series_id", micros("ts"), "value")


@query("select_series_prefix", f"WITH {EV} SELECT series_id, us AS ts_us, value FROM ev WHERE name LIKE 'e%' OR name LIKE 's%'")
def by_prefix(spark, sf):
    rows = events(spark, sf)
    both = select_series(rows, prefix="e").unionByName(select_series(rows, prefix="s"))
    return both.select("series_id", micros("ts"), "value")


@query("label_match", """SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, count(*) AS n,
  round(sum(l_extendedprice), 2) AS total FROM lineitem
  WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1, 2""")
def matching(spark, sf):
    """A wanted label that is absent equals the empty string."""
    rows = lineitem(spark, sf)
    found = rows.where(label_match(F.col("labels"), {"returnflag": "R", "linestatus": "F", "zone": ""}))
    flag, status = label(F.col("labels"), "returnflag"), label(F.col("labels"), "linestatus")
    return found.groupBy(flag.alias("returnflag"), status.alias("linestatus")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("time_range", f"""WITH {EV} SELECT series_id, us AS ts_us, value FROM ev
WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-10') AND epoch_us(TIMESTAMP '2024-01-20')""")
def within(spark, sf):
    return time_range(events(spark, sf), utc(2024, 1, 10), utc(2024, 1, 20)).select("series_id", micros("ts"), "value")


@query("auto_tier", f"""WITH {EV} SELECT series_id, (sec - sec % 3600) * 1000000 AS bucket_us, round(avg(value), 6) AS avg
FROM ev WHERE name = 'signup' GROUP BY series_id, sec - sec % 3600""")
def charted(spark, sf):
    """A 40-day chart reads the hour tier."""
    start, end = utc(2023, 12, 25), utc(2024, 2, 3)
    tiers = {"raw": None, "minute": None, "hour": rollup(events(spark, sf), 3600)}
    found = query_range(tiers, "signup", {}, start, end, auto_tier((end - start).total_seconds()))
    return found.select("series_id", micros("bucket"), r6("avg"))


@query("empty_series", f"""WITH {PT} SELECT DISTINCT name, series_id FROM pt WHERE name = 'click' AND series_id NOT IN (
  SELECT series_id FROM pt WHERE sec BETWEEN epoch(TIMESTAMP '2024-01-15') AND epoch(TIMESTAMP '2024-01-15 02:00:00'))""")
def silent(spark, sf):
    return empty_series(stored_tiers(spark, sf), "click", {}, utc(2024, 1, 15), utc(2024, 1, 15, 2)).select("name", "series_id")


@query("compare_op", f"""WITH {EV}, ops AS (SELECT unnest(['>', '<', '>=', '<=', '==', '!=', '~']) AS operator)
SELECT name, operator, CAST(count_if(CASE operator WHEN '>' THEN value > 12.31 WHEN '<' THEN value < 12.31
  WHEN '>=' THEN value >= 12.31 WHEN '<=' THEN value <= 12.31 WHEN '==' THEN value = 12.31 WHEN '!=' THEN value <> 12.31
  ELSE false END) AS BIGINT) AS n FROM ev, ops GROUP BY name, operator""")
def compared(spark, sf):
    ops = F.explode(F.array(*[F.lit(o) for o in (*OPERATORS, "~")]))
    rows = events(spark, sf).select("name", "value", ops.alias("operator"))
    return rows.groupBy("name", "operator").agg(
        F.count_if(compare_op(F.col("operator"), F.col("value"), F.lit(12.31))).alias("n")
    )


@query("metric_labels", f"""WITH {EV} SELECT DISTINCT name AS metric, shard, 2::BIGINT AS labels FROM ev""")
def named(spark, sf):
    rows = events(spark, sf).select(metric_labels(F.col("name"), F.col("labels")).alias("m"))
    return rows.select(
        label(F.col("m"), "__name__").alias("metric"), label(F.col("m"), "shard").alias("shard"),
        F.size("m").cast("long").alias("labels"),
    ).distinct()


@query("list_series", f"WITH {EV} SELECT DISTINCT series_id, name, shard FROM ev")
def series(spark, sf):
    return list_series(events(spark, sf)).select("series_id", "name", label(F.col("labels"), "shard").alias("shard"))


@query("list_metrics", "SELECT DISTINCT event_type AS name FROM events")
def metrics(spark, sf):
    return list_metrics(events(spark, sf))


@query("latest_per_series", f"""WITH {EV} SELECT series_id, max(us) AS ts_us, arg_max(value, us) AS value FROM ev GROUP BY series_id""")
def latest(spark, sf):
    return latest_per_series(events(spark, sf)).select("series_id", micros("ts"), "value")


@query("latest_lookback", f"""WITH {EV} SELECT series_id, max(us) AS ts_us, arg_max(value, us) AS value FROM ev
WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-14 18:00:00') AND epoch_us(TIMESTAMP '2024-01-15') GROUP BY series_id""")
def latest_recent(spark, sf):
    """Six hours back, in which most series have points at every size of the tables."""
    now = F.lit(utc(2024, 1, 15))
    return latest_per_series(events(spark, sf), now, 6 * 3600).select("series_id", micros("ts"), "value")


@query("latest_sum", f"""WITH {EV} SELECT round(sum(value), 6) AS value FROM (
  SELECT arg_max(value, us) AS value FROM ev WHERE name = 'view' GROUP BY series_id)""")
def latest_total(spark, sf):
    return latest_sum(events(spark, sf), "view").select(r6("value"))


@query("last_n", f"""WITH {EV} SELECT series_id, us AS ts_us, value FROM ev
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY us DESC) <= 120""")
def newest(spark, sf):
    return last_n(events(spark, sf), 120).select("series_id", micros("ts"), "value")


@query("series_index", f"WITH {EV} SELECT DISTINCT series_id, name, shard FROM ev")
def catalogue(spark, sf):
    """All series from the index of the stored tiers."""
    found = indexed_series(stored_tiers(spark, sf)["series"])
    return found.select("series_id", "name", label(F.col("labels"), "shard").alias("shard"))


@query("index_metrics", "SELECT DISTINCT event_type AS name FROM events WHERE event_type >= 'p'")
def index_names(spark, sf):
    return indexed_metrics(stored_tiers(spark, sf)["series"]).where(F.col("name") >= "p")


@query("find_series", f"""WITH {EV} SELECT DISTINCT 'pair' AS wanted, series_id FROM ev WHERE shard = '3'
UNION ALL SELECT DISTINCT 'missing', series_id FROM ev WHERE name = 'click'""")
def found_series(spark, sf):
    """Series with a label, and series without one, by the index."""
    index = stored_tiers(spark, sf)["series"]
    one = find_series(index, None, {"shard": "3"}).select(F.lit("pair").alias("wanted"), "series_id")
    return one.unionByName(find_series(index, "click", {"zone": ""}).select(F.lit("missing").alias("wanted"), "series_id"))
