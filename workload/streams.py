"""Streams over the event table, each run to the end of its input."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from sparktide.operators import alerts as A
from sparktide.operators.anomaly import train_models
from sparktide.operators.rollup import rollup
from sparktide.functions.labels import label, series_id
from sparktide.sinks.fanout import fan_out
from sparktide.schema import MODELS
from sparktide.sinks.lake import read_tiers, stream_tiers
from sparktide.sources.remote_write import decode_remote_write
from sparktide.streaming.alerts import notify, stream_alerts
from sparktide.streaming.export import start_export, stream_export, stream_forward
from sparktide.streaming.rollups import stream_dedup, stream_rollup
from sparktide.streaming.scoring import retrain, stream_score
from workload.alerting import EVENTS_SQL, NOTIFIERS, RULES, SENT as _SENT, alert_rows
from workload.alerting import SILENT_RULES, SILENT_SQL
from workload.inputs import EV, PT, event_file, event_files, events, file_stream, folder, label_of_week, micros, points, query, r6, shard, utc
from workload.storing import TIERS_SQL, stored_tiers, tier_rows
from workload.scoring import _plain_models, gap_sql, models_sql


def event_stream(spark, sf):
    """Event samples in order of arrival, three files and so three micro-batches; the tasks of a batch see a part of it each."""
    return file_stream(spark, sf, event_files(spark, sf))


def land(spark, rows, name):
    """Run a stream to its end into files and read them."""
    base = folder(spark, name)
    (rows.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
     .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{base}/out")


def each_batch(spark, rows, consume, name):
    """Run a stream to its end through a foreachBatch function."""
    base = folder(spark, name)
    (rows.writeStream.foreachBatch(consume).option("checkpointLocation", f"{base}/progress")
     .trigger(availableNow=True).start().awaitTermination())
    return base


@query("stream_rollup", f"""WITH {EV} SELECT series_id, (sec - sec % 3600) * 1000000 AS bucket_us, round(min(value), 6) AS min,
  round(avg(value), 6) AS avg, round(max(value), 6) AS max FROM ev GROUP BY series_id, sec - sec % 3600
HAVING (sec - sec % 3600 + 3600) * 1000 <= (SELECT max(us) // 1000 FROM ev)""")
def rolled(spark, sf):
    """Hour buckets the watermark has passed; the files follow each other in time, so nothing is late."""
    out = land(spark, stream_rollup(event_stream(spark, sf), 3600, "0 seconds"), "rollup")
    return out.select("series_id", micros("bucket"), r6("min"), r6("avg"), r6("max"))


@query("stream_dedup", f"WITH {PT} SELECT series_id, sec, value, seq, shard FROM pt")
def deduped(spark, sf):
    out = land(spark, stream_dedup(event_stream(spark, sf)), "dedup")
    return out.select("series_id", "sec", "value", "seq", label(F.col("labels"), "shard").alias("shard"))


@query("stream_alerts", EVENTS_SQL)
def alerts(spark, sf):
    stream = event_stream(spark, sf).withColumn("anomalous", F.col("value") > 45)
    return alert_rows(land(spark, stream_alerts(stream, A.load_rules(spark, RULES)), "alerts"))


@query("stream_score", f"""WITH RECURSIVE {models_sql(PT, "SELECT epoch(TIMESTAMP '2024-01-11')::BIGINT AS t", 10 * 86400)},
dv AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS d FROM ev),
sm AS (SELECT *, CASE WHEN count(d) OVER w = 3 THEN avg(d) OVER w END AS m FROM dv
  WINDOW w AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
fx AS (SELECT *, {", ".join(f"lag(m, {5 - i}) OVER w AS x{i}" for i in range(6))} FROM sm WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
vote AS (SELECT fx.seq, CASE WHEN lo = hi THEN 0 ELSE least(100, 100 * abs((({gap_sql("c0")} + {gap_sql("c1")}) / 2 - lo) / (hi - lo))) END >= 60 AS a
  FROM fx JOIN mo ON fx.series_id = mo.series_id AND t * 1000000 <= us WHERE x0 IS NOT NULL)
SELECT ev.series_id, ev.us AS ts_us, ev.value, coalesce(a, false) AS anomalous FROM ev LEFT JOIN vote ON ev.seq = vote.seq""")
def scored(spark, sf):
    """Stream scores against models trained from the first ten days."""
    trained = train_models(points(spark, sf), train_at=[utc(2024, 1, 11)], window_s=10 * 86400)
    base = folder(spark, "models")
    trained.write.mode("overwrite").parquet(f"{base}/models")
    models = spark.read.parquet(f"{base}/models")
    out = land(spark, stream_score(event_stream(spark, sf), models, threshold=60.0), "score")
    return out.select("series_id", micros("ts"), "value", "anomalous")


@query("retrain", f"""WITH RECURSIVE {models_sql(PT, "SELECT unnest([epoch(TIMESTAMP '2024-01-11')::BIGINT, epoch(TIMESTAMP '2024-01-16')::BIGINT]) AS t", 10 * 86400)}
SELECT series_id, t * 1000000 AS trained_at_us, round(lo, 6) AS min_dist, round(hi, 6) AS max_dist FROM mo""")
def retrained(spark, sf):
    """Two scheduled trainings from the stored raw tier, appended to one model table."""
    base = folder(spark, "models")
    for now in (utc(2024, 1, 11), utc(2024, 1, 16)):
        retrain(stored_tiers(spark, sf)["raw"], f"{base}/models", now, window_s=10 * 86400)
    return spark.read.parquet(f"{base}/models").select("series_id", micros("trained_at"), r6("min_dist"), r6("max_dist"))


@query("stream_score_plain", f"""WITH {EV}, dv AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS d FROM ev),
fm AS (SELECT *, CASE WHEN count(d) OVER w = 3 THEN avg(d) OVER w END AS m FROM dv
  WINDOW w AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
fx AS (SELECT *, {", ".join(f"lag(m, {5 - i}) OVER w AS x{i}" for i in range(6))} FROM fm WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
md AS (SELECT series_id, p + 432000 AS trained, round(a, 3) / 10 AS c, round(b, 3) * 0.4::DOUBLE AS hi FROM (
    SELECT series_id, sec - sec % 432000 AS p, avg(value) AS a, max(value) AS b FROM (
      SELECT *, max(sec) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ev)
    WHERE seen IS NULL OR sec > seen GROUP BY 1, 2)),
top AS (SELECT fx.*, c, hi FROM fx JOIN md ON fx.series_id = md.series_id AND trained * 1000000 <= us WHERE x0 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY fx.seq ORDER BY trained DESC) <= 3),
vote AS (SELECT seq, bool_and(least(100, 100 * abs(((
    sqrt({" + ".join(f"x{i}*x{i}" for i in range(6))}) + sqrt({" + ".join(f"(x{i}-c)*(x{i}-c)" for i in range(6))})) / 2) / hi)) >= 70) AS a
  FROM top GROUP BY seq)
SELECT ev.series_id, ev.us AS ts_us, ev.value, coalesce(a, false) AS anomalous FROM ev LEFT JOIN vote ON ev.seq = vote.seq""")
def scored_plain(spark, sf):
    """Stream scores against the three models in force at each sample's time, of a table SQL can compute."""
    base = folder(spark, "models")
    _plain_models(points(spark, sf)).write.mode("overwrite").parquet(f"{base}/models")
    models = spark.read.parquet(f"{base}/models")
    out = land(spark, stream_score(event_stream(spark, sf), models, model_count=3, threshold=70.0), "score")
    return out.select("series_id", micros("ts"), "value", "anomalous")


@query("stream_export", f"""WITH {EV} SELECT 'n1' AS node_id, name AS metric_name, '{{"shard":"' || shard || '"}}' AS labels_json,
  (sec - sec % 60) * 1000000 AS ts_us, round(avg(value), 6) AS value, false AS anomaly_bit FROM ev GROUP BY name, shard, sec - sec % 60""")
def exported(spark, sf):
    """Minute buckets landed as a table, streamed into the lake layout; a second run finds nothing new."""
    base = folder(spark, "export")
    rollup(events(spark, sf), 60).write.mode("overwrite").parquet(f"{base}/minutes")
    known = spark.read.parquet(f"{base}/minutes").schema
    for _ in range(2):
        stream = spark.readStream.schema(known).parquet(f"{base}/minutes")
        start_export(stream_export(stream, "n1", "host1"), f"{base}/lake", f"{base}/progress").awaitTermination()
    out = spark.read.parquet(f"{base}/lake")
    return out.select("node_id", "metric_name", "labels_json", micros("ts"), r6("value"), "anomaly_bit")


@query("stream_forward", f"WITH {EV} SELECT name, shard, us // 1000 AS ts_ms, value FROM ev")
def forwarded(spark, sf):
    """Wire bodies of the stream, delivered to files and read back."""
    out = folder(spark, "bodies")

    def deliver(bodies, batch_id):
        bodies.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    each_batch(spark, event_stream(spark, sf), stream_forward(deliver), "forward")
    back = decode_remote_write(spark.read.parquet(out))
    return back.select("name", label(F.col("labels"), "shard").alias("shard"), F.unix_millis("ts").alias("ts_ms"), "value")


@query("fan_out", f"""WITH {EV}, bt AS (SELECT *, CAST(floor(seq * 3::DOUBLE / (SELECT max(seq) + 1 FROM ev)) AS BIGINT) AS b FROM ev)
SELECT 'raw' AS consumer, series_id, count(*) AS n FROM bt GROUP BY series_id
UNION ALL SELECT 'hour', series_id, count(DISTINCT b * 1000000 + sec // 3600) FROM bt GROUP BY series_id
UNION ALL SELECT 'failed', 'bad', count(DISTINCT b) FROM bt""")
def fanned(spark, sf):
    """Two consumers get the stream although a third one fails; its failure is kept as a row."""
    out = folder(spark, "fan")

    def keep(kind, rows, batch_id):
        rows.select(F.lit(kind).alias("consumer"), "series_id").write.mode("overwrite").parquet(f"{out}/{kind}-{batch_id}")

    def broken(batch, batch_id):
        raise RuntimeError("consumer is down")

    def note(name, batch_id, problem):
        spark.range(1).select(F.lit("failed").alias("consumer"), F.lit(name).alias("series_id")).write.mode("overwrite").parquet(f"{out}/failed-{batch_id}")

    consumers = {
        "raw": lambda b, i: keep("raw", b, i), "bad": broken, "hour": lambda b, i: keep("hour", rollup(b, 3600), i),
    }
    each_batch(spark, event_stream(spark, sf), fan_out(consumers, note), "fan")
    return spark.read.parquet(f"{out}/*").groupBy("consumer", "series_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_tiers", TIERS_SQL)
def into_tiers(spark, sf):
    """The three tiers fed by a stream, a call for each micro-batch; run again from its checkpoint it adds nothing."""
    path, base = folder(spark, "tiers"), folder(spark, "tier-progress")
    for _ in range(2):
        (event_stream(spark, sf).writeStream.foreachBatch(stream_tiers(path)).option("checkpointLocation", base)
         .trigger(availableNow=True).start().awaitTermination())
    return tier_rows(read_tiers(spark, path))


@query("stream_alerts_silent", SILENT_SQL)
def silent_alerts(spark, sf):
    """Alerts that resolve when their series falls silent, by timers."""
    rules = A.load_rules(spark, SILENT_RULES)
    return alert_rows(land(spark, stream_alerts(event_stream(spark, sf), rules, "0 seconds"), "alerts"))


@query("notify", f"""WITH {_SENT} SELECT notifier, rule, firing, count(*) AS n FROM sent GROUP BY ALL""")
def notified(spark, sf):
    """Alert events of a stream handed to two notifiers, each writing the payloads it gets."""
    out = folder(spark, "sent")
    routes_to = A.load_notifiers(spark, NOTIFIERS)

    def deliver(payloads, batch_id):
        payloads.select("notifier", "rule", "firing", "payload").write.mode("append").parquet(out)

    stream = event_stream(spark, sf).withColumn("anomalous", F.col("value") > 45)
    found = stream_alerts(stream, A.load_rules(spark, RULES))
    each_batch(spark, found, notify(routes_to, {n["notifier"]: deliver for n in NOTIFIERS}), "notify")
    return spark.read.parquet(out).groupBy("notifier", "rule", "firing").agg(F.count(F.lit(1)).alias("n"))


_STEPS = 3
_EDGES = f"""SELECT max(us) // 1000000 + 1 AS t FROM ev GROUP BY floor(seq * {_STEPS}::DOUBLE / (SELECT max(seq) + 1 FROM ev))
  QUALIFY row_number() OVER (ORDER BY max(us)) < {_STEPS}"""


@query("stream_score_retrained", f"""WITH RECURSIVE {models_sql(PT, _EDGES, 10 * 86400)},
dv AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY seq) AS d FROM ev),
sm AS (SELECT *, CASE WHEN count(d) OVER w = 3 THEN avg(d) OVER w END AS m FROM dv
  WINDOW w AS (PARTITION BY series_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
fx AS (SELECT *, {", ".join(f"lag(m, {5 - i}) OVER w AS x{i}" for i in range(6))} FROM sm WINDOW w AS (PARTITION BY series_id ORDER BY seq)),
vote AS (SELECT fx.seq, bool_and(CASE WHEN lo = hi THEN 0 ELSE least(100, 100 * abs((({gap_sql("c0")} + {gap_sql("c1")}) / 2 - lo) / (hi - lo))) END >= 60) AS a
  FROM fx JOIN mo ON fx.series_id = mo.series_id AND t * 1000000 <= us WHERE x0 IS NOT NULL GROUP BY fx.seq)
SELECT ev.series_id, ev.us AS ts_us, ev.value, coalesce(a, false) AS anomalous FROM ev LEFT JOIN vote ON ev.seq = vote.seq""")
def scored_between(spark, sf):
    """A stream fed in three steps, all series retrained after each; samples and models reach it as files."""
    base = folder(spark, "retrained")
    raw = stored_tiers(spark, sf)["raw"]
    spark.createDataFrame([], MODELS).write.parquet(f"{base}/models")
    for k in range(_STEPS):
        event_file(spark, sf, k, _STEPS, f"{base}/in")
        models = spark.readStream.schema(MODELS).parquet(f"{base}/models")
        out = stream_score(file_stream(spark, sf, f"{base}/in"), models, threshold=60.0)
        (out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination())
        if k + 1 < _STEPS:
            second = spark.read.parquet(f"{base}/in").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))) + 1).first()[0]
            retrain(raw, f"{base}/models", datetime.fromtimestamp(second, timezone.utc), window_s=10 * 86400)
    return spark.read.parquet(f"{base}/out").select("series_id", micros("ts"), "value", "anomalous")


@query("stream_forward_series", f"""WITH ev AS (SELECT event_type AS name, event_type || '{{shard="' || CAST(user_id % 4 AS VARCHAR) || '",week="' || week || '"}}' AS series_id, us, value, b
  FROM (SELECT *, epoch_us(ts) AS us, CAST(epoch_us(ts) // 604800000000 AS VARCHAR) AS week, floor(event_id * 3::DOUBLE / (SELECT max(event_id) + 1 FROM events)) AS b FROM events)),
cl AS (SELECT b, max(max(us)) OVER (ORDER BY b) AS clock FROM ev GROUP BY b),
fi AS (SELECT series_id, min(b) AS first FROM ev GROUP BY 1)
SELECT ev.series_id, us // 1000 AS ts_ms, value FROM ev JOIN fi USING (series_id) JOIN cl USING (b) WHERE b > first OR us >= clock - 86400000000""")
def forwarded_by_series(spark, sf):
    """A series for each week, so that most begin late; a new one sends its last day, and all that follows."""
    out, progress = folder(spark, "bodies"), folder(spark, "forward-progress")

    def deliver(bodies, batch_id):
        bodies.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    rows = file_stream(spark, sf, event_files(spark, sf), {"shard": shard(), "week": label_of_week()})
    each_batch(spark, rows, stream_forward(deliver, progress=progress, interval_s=86400), "forward")
    back = decode_remote_write(spark.read.parquet(out))
    return back.select(series_id(F.col("name"), F.col("labels")).alias("series_id"), F.unix_millis("ts").alias("ts_ms"), "value")
