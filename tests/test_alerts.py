"""Rules, conditions, hysteresis and routing; batch and streaming."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import at, rel, samples
from sparktide.operators import alerts as A
from sparktide.sinks.text import alert_payloads

HIGH = {"rule": "high", "metric": "cpu", "cond_type": "threshold", "operator": ">", "threshold": 90, "for_s": "30s"}


def events(spark, rows, *rules, **kw):
    loaded = A.load_rules(spark, rules)
    ev = A.alert_events(A.evaluate_rules(samples(spark, rows), loaded), loaded, **kw)
    return [(r.rule, rel(r.at), r.firing, rel(r.since)) for r in ev.orderBy("rule", "at").collect()]


def test_fires_after_the_wait_and_resolves(spark):
    rows = [("cpu", {}, 0, 95), ("cpu", {}, 31, 96), ("cpu", {}, 32, 10)]
    assert events(spark, rows, HIGH) == [("high", 31, True, 0), ("high", 32, False, 32)]
    assert events(spark, rows[:1], HIGH) == []


def test_a_dip_starts_over(spark):
    assert events(spark, [("cpu", {}, 0, 95), ("cpu", {}, 10, 50), ("cpu", {}, 30, 95)], HIGH) == []


def test_rule_labels_must_be_on_the_sample(spark):
    rule = {**HIGH, "labels": {"host": "a"}, "for_s": 0, "threshold": 0}
    rows = [("memory", {"host": "a"}, 0, 1), ("cpu", {"host": "b"}, 0, 1), ("cpu", {"host": "a", "extra": "label"}, 0, 1)]
    got = A.match_rules(samples(spark, rows), A.load_rules(spark, [rule])).collect()
    assert [r.labels for r in got] == [{"host": "a", "extra": "label"}]


def test_rate_of_change(spark):
    rule = {"rule": "r", "metric": "requests", "cond_type": "rate_of_change", "operator": ">", "threshold": 5, "window_s": "1m"}
    assert events(spark, [("requests", {}, 0, 0), ("requests", {}, 60, 600)], rule) == [("r", 60, True, 60)]
    # one second further the old sample has left the window
    assert events(spark, [("requests", {}, 0, 0), ("requests", {}, 61, 600)], rule) == []


def test_anomaly_and_own_conditions(spark):
    rows = [("cpu", {}, 0, 1, None, True), ("cpu", {}, 1, 2)]
    assert events(spark, rows, {"rule": "a", "metric": "cpu", "cond_type": "anomaly"}) == [("a", 0, True, 0), ("a", 1, False, 1)]
    A.register_condition("even", lambda: F.col("value") % 2 == 0)
    try:
        assert events(spark, rows, {"rule": "e", "metric": "cpu", "cond_type": "even"}) == [("e", 1, True, 1)]
    finally:
        A.CONDITION_COLUMNS.clear()


class Machine:
    """Sample-by-sample evaluation, as a check on the set-based form."""

    def __init__(self, rule):
        self.rule, self.pending, self.firing, self.past, self.out = rule, None, False, [], []

    def feed(self, t, v):
        r = self.rule
        if r["cond_type"] == "rate_of_change":
            self.past = [p for p in self.past + [(t, v)] if p[0] >= t - r["window_s"]]
            gone = t - self.past[0][0]
            holds = gone > 0 and (v - self.past[0][1]) / gone > r["threshold"]
        else:
            holds = v > r["threshold"]
        if not holds:
            if self.firing:
                self.out.append((r["rule"], t, False, t))
            self.pending, self.firing = None, False
            return
        if self.pending is None:
            self.pending = t
        if not self.firing and t - self.pending >= r["for_s"]:
            self.firing = True
            self.out.append((r["rule"], t, True, self.pending))


RANDOM_RULES = [
    {"rule": "rate", "metric": "cpu", "cond_type": "rate_of_change", "operator": ">", "threshold": 0.05, "window_s": 25, "for_s": 15},
    {"rule": "rate2", "metric": "cpu", "cond_type": "rate_of_change", "operator": ">", "threshold": 0.0, "window_s": 300, "for_s": 0},
    {"rule": "wait", "metric": "cpu", "cond_type": "threshold", "operator": ">", "threshold": 5, "for_s": 40},
    {"rule": "now", "metric": "cpu", "cond_type": "threshold", "operator": ">", "threshold": 8, "for_s": 0},
]


def random_walk(seed, n=150):
    rng = random.Random(seed)
    t, v, rows = 0, 5, []
    for _ in range(n):
        t += rng.choice([1, 3, 10, 60])
        v = min(10, max(0, v + rng.choice([-3, -1, 0, 1, 1, 2])))
        rows.append((t, v))
    return rows


@pytest.mark.parametrize("slice_s", [20, 500, 10_000])
def test_events_equal_the_state_machine(spark, slice_s):
    rows = random_walk(slice_s)
    want = []
    for rule in RANDOM_RULES:
        m = Machine(rule)
        for t, v in rows:
            m.feed(t, v)
        want += m.out
    assert events(spark, [("cpu", {}, t, v) for t, v in rows], *RANDOM_RULES, slice_s=slice_s) == sorted(want)


@pytest.mark.parametrize("slice_s", [7, 100])
def test_rate_does_not_depend_on_slices(spark, slice_s):
    s = samples(spark, [("cpu", {}, t, v) for t, v in random_walk(3)])
    a = A.rate_of_change(s, 30, slice_s=slice_s).select("ts", "rate").collect()
    b = A.rate_of_change(s, 30).select("ts", "rate").collect()
    assert sorted(a) == sorted(b) and len(a) == 150


def test_streaming_equals_batch(spark, tmp_path):
    from sparktide.streaming.alerts import stream_alerts
    rows = random_walk(11)
    s = samples(spark, [("cpu", {}, t, v) for t, v in rows])
    # three files in time order, one per micro-batch
    for i, (lo, hi) in enumerate(((0, 900), (900, 2000), (2000, 10 ** 9))):
        part = s.where((F.col("sec") - int(at(0).timestamp()) >= lo) & (F.col("sec") - int(at(0).timestamp()) < hi))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rules = A.load_rules(spark, RANDOM_RULES)
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (stream_alerts(stream, rules).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.rule, rel(r.at), r.firing, rel(r.since)) for r in got.collect()) == sorted(
        events(spark, [("cpu", {}, t, v) for t, v in rows], *RANDOM_RULES))


def test_firing_now(spark):
    rows = [("cpu", {"h": h}, t, v) for h, vs in (("a", (95, 96, 97)), ("b", (95, 96, 1)), ("c", (1, 95, 95)))
            for t, v in zip((0, 40, 80), vs)]
    loaded = A.load_rules(spark, [HIGH])
    got = A.firing_alerts(A.evaluate_rules(samples(spark, rows), loaded), loaded).collect()
    assert [(r.labels["h"], r.value, rel(r.since)) for r in got] == [("a", 97, 0), ("c", 95, 40)]


def test_routing_and_payloads(spark):
    note = A.load_notifiers(spark, [{"notifier": "hook", "type": "webhook"}, {"notifier": "chat", "type": "slack"}])
    rules = [{**HIGH, "for_s": 0}, {**HIGH, "rule": "named", "for_s": 0, "notify": ["chat", "gone"], "severity": "critical"}]
    rows = [("cpu", {"z": "1", "a": "x<y"}, 3661, 95.5), ("cpu", {"z": "1", "a": "x<y"}, 3662, 1)]
    loaded = A.load_rules(spark, rules)
    ev = A.alert_events(A.evaluate_rules(samples(spark, rows), loaded), loaded)
    sent = alert_payloads(A.route_alerts(ev, note)).collect()
    assert sorted((r.rule, r.notifier, r.firing) for r in sent) == [
        ("high", "chat", False), ("high", "chat", True), ("high", "hook", False), ("high", "hook", True),
        ("named", "chat", False), ("named", "chat", True)]
    text = {(r.rule, r.notifier, r.firing): r.payload for r in sent}
    hook = json.loads(text["high", "hook", True])
    assert hook == {"rule": "high", "metric": "cpu", "labels": {"a": "x<y", "z": "1"}, "severity": "warning", "value": 95.5,
                    "since": "2024-01-01T01:01:01Z", "firing": True}
    assert json.loads(text["named", "chat", True]) == {
        "text": "\U0001F534 *FIRING* [critical] cpu{a=x<y,z=1} = 95.5 (since 01:01:01)"}
    assert json.loads(text["named", "chat", False]) == {"text": "✅ *RESOLVED* [critical] cpu{a=x<y,z=1} = 1"}


def test_each_notifier_gets_its_rows(spark):
    from sparktide.streaming.alerts import notify
    note = A.load_notifiers(spark, [{"notifier": "hook", "type": "webhook"}, {"notifier": "chat", "type": "slack"}])
    rules = A.load_rules(spark, [{**HIGH, "for_s": 0, "notify": ["chat"]}, {**HIGH, "rule": "all", "for_s": 0}])
    ev = A.alert_events(A.evaluate_rules(samples(spark, [("cpu", {}, 0, 95)]), rules), rules)
    sent, failed = {}, []

    def chat(rows, batch_id):
        sent["chat"] = sorted(r.rule for r in rows.collect())

    def hook(rows, batch_id):
        raise RuntimeError(f"{rows.count()} not sent")

    notify(note, {"hook": hook, "chat": chat}, lambda n, i, e: failed.append((n, i, str(e))))(ev, 3)
    assert sent == {"chat": ["all", "high"]} and failed == [("hook", 3, "1 not sent")]


@pytest.mark.parametrize("change", [
    {"rule": ""}, {"metric": ""}, {"for_s": -1}, {"severity": "loud"}, {"cond_type": "magic"}, {"operator": "~"},
    {"cond_type": "rate_of_change", "window_s": 0}, {"notify": ["nobody"]},
])
def test_bad_rules(spark, change):
    with pytest.raises(ValueError):
        A.load_rules(spark, [{**HIGH, **change}], notifiers=["hook"])


def test_bad_anomaly_rule_and_notifiers(spark):
    with pytest.raises(ValueError):
        A.load_rules(spark, [{"rule": "a", "metric": "m", "cond_type": "anomaly"}], scoring=False)
    assert len(A.check_notifiers([{"notifier": "", "type": "slack"}, {"notifier": "a", "type": "x"}, {"notifier": "a", "type": "slack"}])) == 3
    assert A.load_rules(spark, [HIGH]).table.first().severity == "warning"
