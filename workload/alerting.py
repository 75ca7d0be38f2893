"""Rules, events, routing, payloads."""

from pyspark.sql import functions as F

from sparktide.functions.labels import label
from sparktide.operators import alerts as A
from sparktide.sinks.text import alert_payloads
from workload.inputs import EV, events, micros, query, r6, table

RULES = [
    {"rule": "high_click", "metric": "click", "cond_type": "threshold", "operator": ">", "threshold": 60, "for_s": "1h"},
    {"rule": "rising_view", "metric": "view", "cond_type": "rate_of_change", "operator": ">", "threshold": 0.01,
     "window_s": "4h"},
    {"rule": "low_error", "metric": "error", "labels": {"shard": "2"}, "cond_type": "threshold", "operator": "<",
     "threshold": 30, "for_s": "2h", "severity": "critical", "notify": ["chat"]},
    {"rule": "any_purchase", "metric": "purchase", "cond_type": "threshold", "operator": ">=", "threshold": 0,
     "for_s": "1d", "severity": "info", "notify": ["hook", "gone"]},
    {"rule": "odd_signup", "metric": "signup", "cond_type": "anomaly", "for_s": "30m"},
]
NOTIFIERS = [{"notifier": "hook", "type": "webhook"}, {"notifier": "chat", "type": "slack"}]

MATCHED = EV + """, ol AS (SELECT *, first_value(us) OVER w AS ous, first_value(value) OVER w AS ov FROM ev
  WINDOW w AS (PARTITION BY series_id ORDER BY us RANGE BETWEEN 14400000000 PRECEDING AND CURRENT ROW)),
m AS (
  SELECT 'high_click' AS rule, 'warning' AS severity, 3600000000 AS wait, 'all' AS notify, *, value > 60 AS holds FROM ol WHERE name = 'click'
  UNION ALL SELECT 'rising_view', 'warning', 0, 'all', *,
    coalesce(us > ous AND (value - ov) / ((us - ous) / 1e6::DOUBLE) > 0.01, false) FROM ol WHERE name = 'view'
  UNION ALL SELECT 'low_error', 'critical', 7200000000, 'chat', *, value < 30 FROM ol WHERE name = 'error' AND shard = '2'
  UNION ALL SELECT 'any_purchase', 'info', 86400000000, 'hook', *, value >= 0 FROM ol WHERE name = 'purchase'
  UNION ALL SELECT 'odd_signup', 'warning', 1800000000, 'all', *, value > 45 FROM ol WHERE name = 'signup')"""

STATES = MATCHED + """, s1 AS (SELECT *, coalesce(lag(holds) OVER w, false) AS was FROM m WINDOW w AS (PARTITION BY rule, series_id ORDER BY us, seq)),
s2 AS (SELECT *, max(CASE WHEN holds AND NOT was THEN us END) OVER (PARTITION BY rule, series_id ORDER BY us, seq) AS pending FROM s1),
s3 AS (SELECT *, holds AND us - pending >= wait AS firing FROM s2),
s4 AS (SELECT *, coalesce(lag(firing) OVER (PARTITION BY rule, series_id ORDER BY us, seq), false) AS was_firing FROM s3)"""

EVENTS_SQL = f"""WITH {STATES} SELECT rule, name AS metric, series_id, severity, round(value, 6) AS value,
  CASE WHEN firing THEN pending ELSE us END AS since_us, us AS at_us, firing FROM s4 WHERE firing <> was_firing"""


def flagged(spark, sf):
    """Event samples with the anomaly flag on unusually large sign-up values."""
    return events(spark, sf).withColumn("anomalous", F.col("value") > 45)


def evaluated(spark, sf):
    return A.evaluate_rules(flagged(spark, sf), A.load_rules(spark, RULES))


def alert_rows(ev):
    return ev.select("rule", "metric", "series_id", "severity", r6("value"), micros("since"), micros("at"), "firing")


@query("load_rules", """SELECT 'high_' || event_type AS rule, event_type AS metric, 'threshold' AS cond_type,
  CASE WHEN count(*) % 2 = 0 THEN 'critical' ELSE 'warning' END AS severity, round(avg(value), 3) AS threshold, 5400.0::DOUBLE AS for_s, 0.0::DOUBLE AS window_s,
  CAST(count(DISTINCT user_id % 4) AS DOUBLE) * 3600 AS silent_s
FROM events GROUP BY event_type""")
def rules(spark, sf):
    """A table of rules, one for each metric from its own values, checked and given its defaults."""
    found = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(
        F.round(F.avg("value"), 3).alias("threshold"), F.when(F.count(F.lit(1)) % 2 == 0, "critical").alias("severity"),
        F.concat(F.count_distinct(F.col("user_id") % 4).cast("string"), F.lit("h")).alias("silent_s"),
    )
    made = found.select(F.concat(F.lit("high_"), "metric").alias("rule"), "*", F.lit("threshold").alias("cond_type"), F.lit(">").alias("operator"), F.lit("1h30m").alias("for_s"))
    rows = A.rules_from(made, notifiers=["hook"]).table
    return rows.select("rule", "metric", "cond_type", "severity", "threshold", "for_s", "window_s", "silent_s")


@query("match_rules", f"WITH {MATCHED} SELECT rule, series_id, us AS ts_us, seq FROM m")
def matched(spark, sf):
    return A.match_rules(flagged(spark, sf), A.load_rules(spark, RULES)).select("rule", "series_id", micros("ts"), "seq")


@query("alert_holds", f"WITH {MATCHED} SELECT rule, series_id, us AS ts_us, holds FROM m")
def holds(spark, sf):
    return evaluated(spark, sf).select("rule", "series_id", micros("ts"), "holds")


@query("rate_of_change", f"""WITH {EV} SELECT series_id, us AS ts_us, round(CASE WHEN us > ous THEN (value - ov) / ((us - ous) / 1e6::DOUBLE) END, 6) AS rate
FROM (SELECT *, first_value(us) OVER w AS ous, first_value(value) OVER w AS ov FROM ev
  WINDOW w AS (PARTITION BY series_id ORDER BY us RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW))""")
def changing(spark, sf):
    return A.rate_of_change(events(spark, sf), 7200).select("series_id", micros("ts"), r6("rate"))


@query("alert_states", f"""WITH {STATES} SELECT rule, series_id, us AS ts_us, holds,
  CASE WHEN holds THEN pending END AS pending_us, firing, was_firing FROM s4""")
def states(spark, sf):
    out = A.alert_states(evaluated(spark, sf))
    return out.select("rule", "series_id", micros("ts"), "holds", micros("pending"), "firing", "was_firing")


@query("alert_events", EVENTS_SQL)
def turned(spark, sf):
    return alert_rows(A.alert_events(evaluated(spark, sf), A.load_rules(spark, RULES)))


@query("firing_alerts", f"""WITH {STATES} SELECT rule, name AS metric, series_id, severity, round(value, 6) AS value, pending AS since_us
FROM s4 WHERE firing QUALIFY us = max(us) OVER (PARTITION BY rule, series_id)
  AND us = (SELECT max(us) FROM m WHERE m.rule = s4.rule AND m.series_id = s4.series_id)""")
def firing(spark, sf):
    out = A.firing_alerts(evaluated(spark, sf), A.load_rules(spark, RULES))
    return out.select("rule", "metric", "series_id", "severity", r6("value"), micros("since"))


_ROUTED = STATES + """, rt AS (SELECT s4.*, n.notifier, n.type FROM s4
  JOIN (VALUES ('hook', 'webhook'), ('chat', 'slack')) AS n(notifier, type) ON s4.notify IN ('all', n.notifier)
  WHERE firing <> was_firing)"""


def routed(spark, sf):
    note = A.load_notifiers(spark, NOTIFIERS)
    return A.route_alerts(A.alert_events(evaluated(spark, sf), A.load_rules(spark, RULES)), note)


@query("route_alerts", f"WITH {_ROUTED} SELECT rule, series_id, us AS at_us, firing, notifier, type FROM rt")
def routes(spark, sf):
    return routed(spark, sf).select("rule", "series_id", micros("at"), "firing", "notifier", "type")


SENT = _ROUTED + """, sent AS (SELECT * FROM rt)"""


_NUM = r"regexp_replace(CAST(value AS VARCHAR), '\.0$', '')"


@query("alert_payloads", f"""WITH {_ROUTED} SELECT rule, series_id, us AS at_us, notifier, CASE type
  WHEN 'webhook' THEN '{{"rule":"' || rule || '","metric":"' || name || '","labels":{{"shard":"' || shard || '"}},"severity":"' || severity
    || '","value":' || {_NUM} || ',"since":"' || strftime(make_timestamp(CASE WHEN firing THEN pending ELSE us END), '%Y-%m-%dT%H:%M:%S')
    || regexp_replace(regexp_replace('.' || lpad(CAST((CASE WHEN firing THEN pending ELSE us END) % 1000000 AS VARCHAR), 6, '0'), '0+$', ''), '\\.$', '')
    || 'Z","firing":' || CAST(firing AS VARCHAR) || '}}'
  ELSE '{{"text":"' || CASE WHEN firing THEN '🔴 *FIRING*' ELSE '✅ *RESOLVED*' END || ' [' || severity || '] ' || name
    || '{{shard=' || shard || '}} = ' || {_NUM}
    || CASE WHEN firing THEN ' (since ' || strftime(make_timestamp(pending), '%H:%M:%S') || ')' ELSE '' END || '"}}' END AS payload
FROM rt""")
def payloads(spark, sf):
    return alert_payloads(routed(spark, sf)).select("rule", "series_id", micros("at"), "notifier", "payload")


@query("alert_labels", f"""WITH {STATES} SELECT rule, shard, count(*) AS events FROM s4 WHERE firing <> was_firing GROUP BY 1, 2""")
def by_label(spark, sf):
    ev = A.alert_events(evaluated(spark, sf), A.load_rules(spark, RULES))
    return ev.groupBy("rule", label(F.col("labels"), "shard").alias("shard")).agg(F.count(F.lit(1)).alias("events"))


SILENT_RULES = [
    {"rule": "high_click", "metric": "click", "cond_type": "threshold", "operator": ">", "threshold": 50, "silent_s": "3h"},
    {"rule": "any_purchase", "metric": "purchase", "cond_type": "threshold", "operator": ">=", "threshold": 0, "for_s": "2h", "severity": "info", "silent_s": "90m"},
    {"rule": "rising_view", "metric": "view", "cond_type": "rate_of_change", "operator": ">", "threshold": 0.01, "window_s": "4h", "silent_s": "2h"},
    {"rule": "low_error", "metric": "error", "cond_type": "threshold", "operator": "<", "threshold": 30},
]

# Where the next sample is farther than the silence, or there is none and the newest sample of all is, a row that does not hold.
SILENT_SQL = f"""WITH {EV}, ol AS (SELECT *, first_value(us) OVER w AS ous, first_value(value) OVER w AS ov FROM ev
  WINDOW w AS (PARTITION BY series_id ORDER BY us RANGE BETWEEN 14400000000 PRECEDING AND CURRENT ROW)),
h AS (SELECT 'high_click' AS rule, 'warning' AS severity, 0 AS wait, 10800000000 AS quiet, *, value > 50 AS holds FROM ol WHERE name = 'click'
  UNION ALL SELECT 'any_purchase', 'info', 7200000000, 5400000000, *, value >= 0 FROM ol WHERE name = 'purchase'
  UNION ALL SELECT 'rising_view', 'warning', 0, 7200000000, *, coalesce(us > ous AND (value - ov) / ((us - ous) / 1e6::DOUBLE) > 0.01, false) FROM ol WHERE name = 'view'
  UNION ALL SELECT 'low_error', 'warning', 0, NULL, *, value < 30 FROM ol WHERE name = 'error'),
nx AS (SELECT *, lead(us) OVER (PARTITION BY rule, series_id ORDER BY us, seq) AS after FROM h),
m AS (SELECT rule, severity, wait, name, series_id, us, seq, value, holds FROM h
  UNION ALL SELECT rule, severity, wait, name, series_id, us + quiet, seq, value, false FROM nx
  WHERE after > us + quiet OR (after IS NULL AND us + quiet <= (SELECT max(us) FROM ev))){STATES.removeprefix(MATCHED)}
SELECT rule, name AS metric, series_id, severity, round(value, 6) AS value,
  CASE WHEN firing THEN pending ELSE us END AS since_us, us AS at_us, firing FROM s4 WHERE firing <> was_firing"""


@query("alert_events_silent", SILENT_SQL)
def turned_silent(spark, sf):
    """Alerts that also resolve when their series sends nothing for a while, up to the newest sample of all."""
    rows = events(spark, sf)
    loaded = A.load_rules(spark, SILENT_RULES)
    until = rows.agg(F.max("ts")).first()[0]
    ev = A.with_silences(A.evaluate_rules(rows, loaded), F.lit(until))
    return alert_rows(A.alert_events(ev, loaded))


@query("register_condition", f"""WITH {EV} SELECT series_id, us AS ts_us, value > 40 AND us // 3600000000 % 24 >= 20 AS holds FROM ev WHERE name = 'view'""")
def own_condition(spark, sf):
    """A condition kind of one's own: high values late in the day."""
    A.register_condition("late_and_high", lambda: (F.col("value") > F.col("threshold")) & (F.hour("ts") >= 20))
    loaded = A.load_rules(spark, [{"rule": "late", "metric": "view", "cond_type": "late_and_high", "threshold": 40}])
    return A.evaluate_rules(events(spark, sf), loaded).select("series_id", micros("ts"), "holds")
