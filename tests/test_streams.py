"""Keyed stream state: several micro-batches against the batch forms, expiry, timers, models that arrive later."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, rel, samples
from sparktide.operators import alerts as A
from sparktide.operators import anomaly as M
from sparktide.operators.store import dedup_ordered
from sparktide.schema import MODELS
from sparktide.streaming.alerts import stream_alerts
from sparktide.streaming.rollups import stream_dedup
from sparktide.streaming.scoring import retrain, stream_score
from sparktide.streaming.state import InOrder


class Feed:
    """A folder that samples are put into, a query over it, and what it has written so far."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema
        (path / "in").mkdir()

    def put(self, rows):
        rows.coalesce(1).write.mode("append").parquet(str(self.path / "in"))

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))

    def run(self, frame):
        q = (frame.writeStream.format("parquet").option("path", str(self.path / "out"))
             .option("checkpointLocation", str(self.path / "progress")).trigger(availableNow=True).start())
        assert q.awaitTermination(300)
        return self.spark.read.parquet(str(self.path / "out"))


def readings(spark, n=600, seed=5):
    rng = random.Random(seed)
    return samples(spark, [("m", {"h": rng.choice("aab")}, rng.randint(0, n), rng.random()) for _ in range(n)])


def parts(s, n):
    return [s.where((F.col("seq") >= 600 // n * k) & (F.col("seq") < 600 // n * (k + 1))) for k in range(n)]


@pytest.mark.parametrize("chunk", [10_000, 7])
def test_dedup_over_several_batches(spark, tmp_path, monkeypatch, chunk):
    """A chunk of 7 rows makes each micro-batch of a series come in many pieces."""
    monkeypatch.setattr("sparktide.streaming.state.ARRIVALS_PER_STRETCH", 50)
    s = readings(spark)
    feed = Feed(spark, tmp_path, s.schema)
    for p in parts(s, 3):
        feed.put(p.orderBy(F.rand(1)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(chunk))
    try:
        got = feed.run(stream_dedup(feed.stream()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in dedup_ordered(s).collect())


def test_silent_series_leaves_the_store(spark, tmp_path):
    s = samples(spark, [("m", {}, 100, 1), ("m", {}, 99, 1), ("k", {}, 120, 1), ("k", {}, 1000, 1)])
    feed = Feed(spark, tmp_path, s.schema)
    for k in range(4):
        feed.put(s.where(F.col("seq") == k))
    out = feed.run(stream_dedup(feed.stream(), 60, "10 seconds"))
    assert sorted((r.name, r.seq) for r in out.collect()) == [("k", 2), ("k", 3), ("m", 0)]
    state = spark.read.format("statestore").option("stateVarName", "newest").load(str(tmp_path / "progress"))
    assert [r.key.series_id for r in state.collect()] == ["k{}"]
    with pytest.raises(ValueError):
        stream_dedup(feed.stream(), 60)


RULES = [
    {"rule": "high", "metric": "m", "cond_type": "threshold", "operator": ">", "threshold": 0.5, "for_s": 20, "silent_s": 40},
    {"rule": "rise", "metric": "m", "cond_type": "rate_of_change", "operator": ">", "threshold": 0.0, "window_s": 60, "silent_s": 30},
    {"rule": "stays", "metric": "m", "cond_type": "threshold", "operator": ">", "threshold": 0.5},
]


def gapped(spark):
    """Ascending times with gaps of up to two minutes, in two series, the second ending early."""
    rng, rows = random.Random(2), []
    for h, n in (("a", 120), ("b", 60)):
        t = 0
        for _ in range(n):
            t += rng.choice([5, 5, 10, 41, 120])
            rows.append(("m", {"h": h}, t, rng.random()))
    rows.sort(key=lambda r: r[2])
    return samples(spark, rows)


def event(r):
    return r.rule, r.series_id, rel(r.at), rel(r.since), r.firing, r.value


@pytest.mark.parametrize("slice_s", [21600, 60])
def test_silences_in_batch(spark, slice_s):
    """Against a sample by sample evaluation."""
    s = gapped(spark)
    rules = A.load_rules(spark, RULES)
    until = rel(s.agg(F.max("ts")).first()[0])
    ev = A.with_silences(A.evaluate_rules(s, rules), at(until), slice_s)
    got = sorted(event(r) for r in A.alert_events(ev, rules, slice_s).collect())
    want = []
    for rule in RULES:
        for series in ("a", "b"):
            rows = [(rel(r.ts), r.value) for r in s.where(F.col("labels")["h"] == series).orderBy("ts").collect()]
            since, firing, last = None, False, None
            name = (rule["rule"], f'm{{h="{series}"}}')
            for t, v in [*rows, (None, None)]:
                quiet = rule.get("silent_s")
                if last and quiet and (t - last[0] > quiet if t is not None else last[0] + quiet <= until):
                    if firing:
                        want.append((*name, last[0] + quiet, last[0] + quiet, False, last[1]))
                    since, firing = None, False
                if t is None:
                    break
                if rule["cond_type"] == "threshold":
                    holds = v > 0.5
                else:
                    old = next(x for x in rows if x[0] >= t - 60)
                    holds = t > old[0] and (v - old[1]) / (t - old[0]) > 0
                since = (t if since is None else since) if holds else None
                now = holds and t - since >= rule.get("for_s", 0)
                if now != firing:
                    want.append((*name, t, since if now else t, now, v))
                firing, last = now, (t, v)
    assert got == sorted(want) and any(not e[4] and e[2] - int(e[2]) == 0 for e in got)


@pytest.mark.parametrize("files", [1, 4])
def test_silences_in_streams_equal_batch(spark, tmp_path, files):
    s = gapped(spark)
    rules = A.load_rules(spark, RULES)
    until = s.agg(F.max("ts")).first()[0]
    feed = Feed(spark, tmp_path, s.schema)
    edge = rel(until) / files
    for k in range(files):
        seconds = F.col("ts").cast("double") - at(0).timestamp()
        feed.put(s.where((seconds > edge * k) & (seconds <= edge * (k + 1))))
    got = feed.run(stream_alerts(feed.stream(), rules, "0 seconds"))
    want = A.alert_events(A.with_silences(A.evaluate_rules(s, rules), at(rel(until))), rules)
    assert sorted(event(r) for r in got.collect()) == sorted(event(r) for r in want.collect())


def test_alert_resolves_without_a_sample(spark, tmp_path):
    """Series b keeps the clock going; a fires, falls silent, resolves and leaves the store."""
    rules = A.load_rules(spark, [{"rule": "high", "metric": "a", "cond_type": "threshold", "operator": ">", "threshold": 1, "silent_s": "1m"}])
    s = samples(spark, [("a", {}, 0, 5), ("b", {}, 30, 0), ("b", {}, 100, 0)])
    feed = Feed(spark, tmp_path, s.schema)
    for k in range(3):
        feed.put(s.where(F.col("seq") == k))
    got = feed.run(stream_alerts(feed.stream(), rules, "0 seconds"))
    assert sorted((r.firing, rel(r.at)) for r in got.collect()) == [(False, 60), (True, 0)]
    state = spark.read.format("statestore").option("stateVarName", "run").load(str(tmp_path / "progress"))
    assert state.count() == 0
    with pytest.raises(ValueError):
        stream_alerts(feed.stream(), rules)


def test_models_that_arrive_between_samples(spark, tmp_path):
    """Samples in three steps with a retraining between them, late samples among them, judged as the batch does."""
    rng = random.Random(9)
    s = samples(spark, [("c", {"h": h}, 5 * i, rng.gauss(0, 40 if i % 50 == 0 else 1)) for i in range(300) for h in "ab"])
    feed = Feed(spark, tmp_path, s.schema)
    spark.createDataFrame([], MODELS).write.parquet(str(tmp_path / "models"))
    edges = [0, 500, 1000, 1500]
    out = None
    for begin, end in zip(edges, edges[1:]):
        sec = F.col("sec") - int(at(0).timestamp())
        feed.put(s.where((sec >= begin) & (sec < end)))
        models = spark.readStream.schema(MODELS).parquet(str(tmp_path / "models"))
        out = feed.run(stream_score(feed.stream(), models, model_count=2, late_s=600))
        if end < 1500:
            for now in (end - 3, end - 1):
                retrain(s, str(tmp_path / "models"), at(now), window_s=400)
    got = {(r.series_id, r.ts): r.anomalous for r in out.collect()}
    trained = spark.read.parquet(str(tmp_path / "models"))
    want = {(r.series_id, r.ts): r.anomalous for r in M.score_samples(s, trained, model_count=2, order=("seq",)).collect()}
    assert got == want and any(want.values())


@pytest.mark.parametrize("chunk", [10_000, 9])
def test_late_sample_is_judged_by_the_models_of_its_time(spark, tmp_path, chunk):
    rng = random.Random(3)
    rows = [("c", {}, 5 * i, rng.gauss(0, 1)) for i in range(200)]
    rows.insert(190, ("c", {}, 500, 90.0))  # arrives long after its time
    s = samples(spark, [(n, labels, t, v, k) for k, (n, labels, t, v) in enumerate(rows)])
    models = M.train_models(s, train_at=[at(t) for t in (300, 400, 600, 700, 800)], window_s=300)
    models.write.parquet(str(tmp_path / "models"))
    models = spark.read.parquet(str(tmp_path / "models"))
    feed = Feed(spark, tmp_path, s.schema)
    for lo, hi in ((0, 100), (100, 185), (185, 300)):
        feed.put(s.where((F.col("seq") >= lo) & (F.col("seq") < hi)).orderBy(F.rand(2)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(chunk))
    try:
        out = feed.run(stream_score(feed.stream(), models, model_count=1, late_s=600))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    got = {r.seq: r.anomalous for r in out.collect()}
    assert got == {r.seq: r.anomalous for r in M.score_samples(s, models, model_count=1, order=("seq",)).collect()}
    assert got[190]


def test_retraining_runs_on_the_workers_of_the_streams(spark, tmp_path, monkeypatch):
    """Plain Python tasks and keyed state start with the same settings; a second set of workers has another parent."""
    def fit(vectors, *_):
        import os
        import numpy

        parent = numpy.full(6, float(os.getppid()))
        return parent, parent, 0.0, 1.0

    name = "spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled"
    before = spark.conf.get(name)
    monkeypatch.setattr(M, "_fit", fit)
    s = samples(spark, [("c", {}, 5 * i, float(i % 7)) for i in range(40)])
    retrain(s, str(tmp_path / "models"), at(200), window_s=400)
    [model] = spark.read.parquet(str(tmp_path / "models")).collect()

    def parent(_):
        import os

        return os.getppid()

    assert model.c0[0] == spark.sparkContext.parallelize([0], 1).map(parent).first()
    assert spark.conf.get(name) == before


def test_waiting_pieces_are_counted_not_listed():
    """Chunks in any order come back sorted, and the pieces' keys are never all asked for."""
    class Waiting(dict):
        def updateValue(self, key, value):
            assert key not in self
            self[key] = value

        getValue, removeKey = dict.__getitem__, dict.__delitem__

        def keys(self):
            raise AssertionError("lists every piece")

    class Plain(InOrder):
        def step(self, key, rows):
            return rows

    waiting = Waiting()
    processor = Plain(["seq"], 50)
    processor.init(type("Handle", (), {"getMapState": lambda *_: waiting})())
    seq = random.Random(4).sample(range(400), 400)
    chunks = [pd.DataFrame({"seq": seq[at : at + 30]}) for at in range(0, 400, 30)]
    got = list(processor.handleInputRows(("k",), iter(chunks), None))
    assert [len(g) for g in got] == [50] * 8 and pd.concat(got)["seq"].tolist() == list(range(400))
    assert len(waiting) == 0
