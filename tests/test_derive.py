"""Rates, derived percentages, joins on time."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import rel, samples
from sparktide.operators import derive as D


def python_rates(points):
    out = []
    for (t0, v0), (t1, v1) in zip(points, points[1:]):
        if t1 - t0 > 0 and v1 - v0 >= 0:
            out.append((t1, (v1 - v0) / (t1 - t0)))
    return out


def test_rate_with_reset(spark):
    s = samples(spark, [("c", {}, t, v) for t, v in ((0, 0), (10, 50), (20, 5), (30, 25))])
    assert [(rel(r.ts), r.rate) for r in D.counter_rate(s).orderBy("ts").collect()] == [(10, 5), (30, 2)]


@pytest.mark.parametrize("slice_s", [5, 10_000])
@pytest.mark.parametrize("turn", [1, -1])
def test_points_of_one_time_in_arrival_order(spark, slice_s, turn):
    rows = [("c", {}, 0, 1, 0), ("c", {}, 10, 5, 1), ("c", {}, 10, 8, 2), ("c", {}, 20, 10, 3), ("c", {}, 20, 12, 4)]
    s = samples(spark, rows[::turn]).coalesce(1)
    assert sorted((rel(r.ts), r.rate) for r in D.counter_rate(s, slice_s).collect()) == [(10, 0.4), (20, 0.2)]


@pytest.mark.parametrize("slice_s", [1, 7, 60, 10_000])
def test_rate_across_slices(spark, slice_s):
    rng = random.Random(slice_s)
    series = {}
    for h in "ab":
        t, v, pts = 0, 0, []
        for _ in range(120):
            t += rng.choice([1, 2, 30, 200])
            v = max(0, v + rng.randint(-5, 20))
            pts.append((t, v))
        series[h] = pts
    s = samples(spark, [("c", {"host": h}, t, v) for h, pts in series.items() for t, v in pts])
    got = sorted((r.labels["host"], rel(r.ts), r.rate) for r in D.counter_rate(s, slice_s).collect())
    want = sorted((h, t, r) for h, pts in series.items() for t, r in python_rates(pts))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_rate_sum_and_where(spark):
    s = samples(spark, [("req", {"status": c}, t, v) for c, step in (("200", 10), ("500", 1), ("503", 2))
                        for t, v in ((0, 0), (10, 10 * step))])
    assert [(rel(r.ts), r.rate) for r in D.rate_sum(s, "req").collect()] == [(10, 13)]
    assert [r.rate for r in D.rate_sum(s, "req", D.server_errors()).collect()] == [3]


def test_cpu_busy(spark):
    rows = [("node_cpu_seconds_total", {"cpu": c, "mode": "idle"}, t, v) for c, r in (("0", 0.5), ("1", 0.9))
            for t, v in ((0, 0), (10, 10 * r))]
    rows += [("node_cpu_seconds_total", {"cpu": "0", "mode": "user"}, t, t) for t in (0, 10)]
    rows += [("node_cpu_usage_percent", {"mode": "idle"}, 0, 85.5)]
    s = samples(spark, rows)
    assert [r.busy for r in D.cpu_busy_percent(s).collect()] == pytest.approx([30])
    assert {r.cpu: round(r.busy, 6) for r in D.cpu_busy_percent(s, per_cpu=True).collect()} == {"0": 50, "1": 10}
    assert [r.busy for r in D.cpu_busy_gauge(s).collect()] == [14.5]


def test_used_percent(spark):
    rows = [("node_memory_MemTotal_bytes", {}, 0, 100), ("node_memory_MemTotal_bytes", {}, 5, 100),
            ("node_memory_MemAvailable_bytes", {}, 0, 25), ("node_memory_MemAvailable_bytes", {}, 9, 25)]
    for m, size in (("/", 10), ("/x", 20)):
        rows.append(("node_filesystem_size_bytes", {"mountpoint": m}, 0, size))
    rows.append(("node_filesystem_avail_bytes", {"mountpoint": "/"}, 0, 1))
    s = samples(spark, rows)
    assert [(rel(r.ts), r.used) for r in D.memory_used_percent(s).collect()] == [(0, 75)]
    assert [(r.labels["mountpoint"], round(r.used, 6)) for r in D.filesystem_used_percent(s).collect()] == [("/", 90)]


def test_average_latency_drops_idle_times(spark):
    sums = samples(spark, [("d_sum", {}, 0, 0), ("d_sum", {}, 10, 5), ("d_sum", {}, 20, 5)])
    counts = samples(spark, [("d_count", {}, 0, 0), ("d_count", {}, 10, 10), ("d_count", {}, 20, 10)])
    assert [(rel(r.ts), r.avg_ms) for r in D.avg_latency_ms(sums, counts).collect()] == [(10, 500)]


def test_primary_interface(spark):
    rows = [("node_network_primary_info", {"device": "en0"}, 0, 1)]
    for d, k in (("en0", 3), ("lo", 100)):
        for kind in ("receive", "transmit"):
            rows += [(f"node_network_{kind}_bytes_total", {"device": d}, t, t * k) for t in (0, 10)]
    got = D.primary_network_rate(samples(spark, rows)).collect()
    assert [(rel(r.ts), r.rx, r.tx) for r in got] == [(10, 3, 3)]


def test_rates_by_time(spark):
    s = samples(spark, [("r", {"d": d}, t, t) for d in "ab" for t in (0, 10)] + [("w", {}, t, t) for t in (0, 20)])
    got = D.rates_by_time(s, {"r": "read", "w": "written"}).orderBy("ts").collect()
    assert [(rel(r.ts), r.read, r.written) for r in got] == [(10, 2, None), (20, None, 1)]


def test_align(spark):
    s = samples(spark, [("c", {"cpu": c}, t, v) for c, t, v in (("2", 0, 1), ("10", 0, 2), ("10", 5, 3))])
    s = s.withColumn("cpu", F.col("labels.cpu"))
    got = D.align_series(s, "cpu", ["2", "10"])
    assert got.columns == ["ts", "2", "10"]
    assert [(rel(r[0]), r[1], r[2]) for r in got.collect()] == [(0, 1, 2), (5, None, 3)]
    long = D.align_points(s, "cpu", order="numeric").collect()
    assert [(rel(r.ts), r.cpu, r.value) for r in long] == [(0, "2", 1), (0, "10", 2), (5, "10", 3)]
    assert [r.cpu for r in D.align_points(s, "cpu").collect()] == ["10", "2", "10"]
    with pytest.raises(ValueError):
        D.align_points(s, "cpu", order="size")
    clash = samples(spark, [("c", {"cpu": "1", "host": h}, 0, v) for h, v in (("a", 1), ("b", 2))]).withColumn("cpu", F.col("labels.cpu"))
    assert [r.value for r in D.align_points(clash, "cpu").collect()] == [1, 2]
    with pytest.raises(Exception, match="several series"):
        D.align_series(clash, "cpu", ["1"]).collect()


def test_hosts_are_paired_with_themselves(spark):
    rows = []
    for k, host in enumerate("abc"):
        who = {"instance": host}
        rows += [("node_memory_MemTotal_bytes", who, 0, 100), ("node_memory_MemAvailable_bytes", who, 0, 10 * k)]
        rows += [("node_network_primary_info", {**who, "device": f"eth{k}"}, 0, 1)]
        rows += [(f"node_network_{way}_bytes_total", {**who, "device": d}, t, t * (k + 1)) for way in ("receive", "transmit") for d in ("eth0", "eth1", "eth2") for t in (0, 10)]
    s = samples(spark, rows)
    got = sorted((r.labels["instance"], round(r.used, 6)) for r in D.memory_used_percent(s).collect())
    assert got == [("a", 100), ("b", 90), ("c", 80)]
    assert sorted((r.instance, round(r.used, 6)) for r in D.memory_used_percent(s, ["instance"]).collect()) == got
    net = sorted((r.labels["instance"], rel(r.ts), r.rx, r.tx) for r in D.primary_network_rate(s).collect())
    assert net == [("a", 10, 1, 1), ("b", 10, 2, 2), ("c", 10, 3, 3)]


def test_red_summary(spark):
    df = spark.createDataFrame([("a", 0.004, "200"), ("a", 0.3, "500"), ("b", 20.0, "200")], "path string, d double, status string")
    got = {r.path: r for r in D.red_summary(df, ["path"], "d", F.col("status").startswith("5")).collect()}
    assert (got["a"].requests, got["a"].errors, got["a"].le_0_005, got["a"].le_0_5) == (2, 1, 1, 2)
    assert (got["b"].le_10, got["b"].le_inf, got["b"].duration_count) == (0, 1, 1)


def test_flatten_cumulative(spark):
    df = spark.createDataFrame(
        [("c", "counter", {}, 1.0, None, None), ("g", "gauge", {}, 2.0, None, None), ("h", "histogram", {"a": "1"}, None, 3.0, 4.0)],
        "name string, type string, labels map<string,string>, value double, sum double, count double")
    got = sorted((r.name, r.value, r.cumulative) for r in D.flatten_cumulative(df).collect())
    assert got == [("c", 1, True), ("g", 2, False), ("h_count", 4, True), ("h_sum", 3, True)]
