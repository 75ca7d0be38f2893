"""Stored points, rollups, retention, selection and the main query."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from helpers import EPOCH, at, rel, samples
from sparktide.operators.rollup import rollup, zip_subseries
from sparktide.operators.select import last_n, latest_per_series, latest_sum, list_metrics, list_series, select_series
from sparktide.operators.store import arrival_carries, arrivals_slice, dedup_ordered, retention, ring_retention, sizing_report, store_points, tier_points
from sparktide.plans.tiers import auto_tier, check_tier, empty_series, parse_label_filter, query_range
from sparktide.schema import normalize_samples, union_sources
from sparktide.sinks.lake import append_tiers

CPU = {"host": "a"}
TEN = [10, 20, 30, 40, 1, 2, 3, 4, 99]


def test_minute_rollup_withholds_the_open_bucket(spark):
    s = samples(spark, [("cpu", CPU, 15 * i, v) for i, v in enumerate(TEN)])
    rows = rollup(s, 60, closed_only=True).orderBy("bucket").collect()
    assert [(rel(r.bucket), r.min, r.avg, r.max) for r in rows] == [(0, 10, 25, 40), (60, 1, 2.5, 4)]
    assert rows[0].labels == CPU and rows[0].name == "cpu"
    assert rollup(s, 60).count() == 3


def test_rollup_ignores_nan_in_min_and_max(spark):
    s = samples(spark, [("cpu", CPU, 0, float("nan")), ("cpu", CPU, 1, 5), ("cpu", CPU, 2, 3), ("cpu", CPU, 61, float("nan"))])
    a, b = rollup(s, 60).orderBy("bucket").collect()
    assert (a.min, a.max) == (3, 5) and a.avg != a.avg
    assert b.min != b.min and b.max != b.max


def test_zip_subseries(spark):
    s = samples(spark, [("cpu#min", CPU, 0, 1), ("cpu#avg", CPU, 0, 2), ("cpu#max", CPU, 0, 3), ("cpu#min", CPU, 60, 1)])
    assert [(r.name, r["min"], r["avg"], r["max"]) for r in zip_subseries(s).collect()] == [("cpu", 1, 2, 3)]


def python_dedup(rows):
    seen, kept = {}, []
    for name, labels, sec, value, seq in sorted(rows, key=lambda r: r[4]):
        key = (name, tuple(sorted(labels.items())))
        if key not in seen or sec > seen[key]:
            seen[key] = sec
            kept.append((name, labels["host"], sec, value))
    return sorted(kept)


@pytest.mark.parametrize("size", [3, 17, 1000])
def test_dedup_equals_a_plain_scan(spark, size):
    rng = random.Random(size)
    rows = [("cpu", {"host": rng.choice("ab")}, rng.randint(0, 60), i, i) for i in range(200)]
    got = dedup_ordered(samples(spark, rows), arrivals_per_slice=size).select("name", "labels.host", "ts", "value").collect()
    assert sorted((r[0], r[1], int(rel(r[2])), r[3]) for r in got) == python_dedup(rows)


def test_stored_points_have_whole_seconds(spark):
    s = samples(spark, [("cpu", CPU, 1.7, 1), ("cpu", CPU, 1.9, 2), ("cpu", CPU, 2.1, 3)])
    assert [(rel(r.ts), r.value) for r in store_points(s).orderBy("ts").collect()] == [(1, 1), (2, 3)]


def test_ring_keeps_at_most_eight_chunks(spark):
    s = samples(spark, [("cpu", CPU, i, i) for i in range(20)])
    kept = [r.value for r in ring_retention(s, 4).orderBy("ts").collect()]
    assert len(kept) <= 8 and kept[-1] == 19


def test_ring_equals_a_plain_ring(spark):
    rng = random.Random(5)
    secs, t = [], 0
    for _ in range(150):
        t += rng.choice([1, 1, 2, 7, 40])
        secs.append(t)
    s = samples(spark, [("cpu", CPU, x, x) for x in secs])
    base = int(EPOCH.timestamp())
    ring = {}
    for x in secs:  # retention 80 s at 1 s: chunks of 10 s
        n = (base + x) // 10
        if ring.get(n % 8, (None,))[0] != n:
            ring[n % 8] = (n, [])
        ring[n % 8][1].append(x)
    want = sorted(x for _, xs in ring.values() for x in xs)
    assert sorted(int(r.value) for r in ring_retention(s, 80).collect()) == want


def test_plain_retention(spark):
    s = samples(spark, [("cpu", CPU, i, i) for i in range(20)])
    assert sorted(r.value for r in retention(s, 5).collect()) == [15, 16, 17, 18, 19]


def test_selection_and_catalogue(spark):
    s = samples(spark, [("cpu", {"host": "a"}, 0, 1), ("cpu", {"host": "b"}, 0, 2), ("mem", {}, 0, 3)])
    assert [r.labels["host"] for r in select_series(s, "cpu", {"host": "b"}).collect()] == ["b"]
    assert [r.series_id for r in list_series(s).collect()] == ['cpu{host="a"}', 'cpu{host="b"}', "mem{}"]
    assert [r.name for r in list_metrics(s, prefix="c").collect()] == ["cpu"]
    assert select_series(s, prefix="m").count() == 1


def test_unlabelled_series_is_not_its_labelled_neighbour(spark):
    s = samples(spark, [("cpu", {}, 0, 1), ("cpu", {"host": "a"}, 0, 2)])
    assert {(r.series_id, r.value) for r in latest_per_series(s).collect()} == {("cpu{}", 1.0), ('cpu{host="a"}', 2.0)}


def test_latest_and_last_n(spark):
    s = samples(spark, [("cpu", CPU, i, i) for i in range(10)] + [("cpu", {"host": "b"}, 400, 7)])
    assert {r.series_id: r.value for r in latest_per_series(s).collect()} == {'cpu{host="a"}': 9, 'cpu{host="b"}': 7}
    assert [r.value for r in latest_per_series(s, F.lit(at(401))).collect()] == [7]
    assert latest_sum(s, "cpu").first().value == 16
    assert latest_sum(s, "none").first().value == 0
    assert sorted(r.value for r in last_n(s, 3).collect()) == [7, 7, 8, 9]


def test_query_range(spark):
    s = samples(spark, [("cpu", CPU, t, v) for t, v in ((0, 10), (15, 20), (30, 30), (60, 99))])
    tiers = {"raw": s, "minute": rollup(s, 60, closed_only=True), "hour": None}
    raw = query_range(tiers, "cpu", "host=a", at(0), at(30)).collect()
    assert [r.value for r in raw] == [10, 20, 30]
    minute = query_range(tiers, "cpu", {}, at(0), at(60), "minute").collect()
    assert [(r["min"], r["avg"], r["max"]) for r in minute] == [(10, 20, 30)]
    assert query_range(tiers, "cpu", {}, at(0), at(60), "hour").count() == 0
    assert [r.series_id for r in empty_series(tiers, "cpu", {}, at(500), at(600)).collect()] == ['cpu{host="a"}']
    with pytest.raises(ValueError):
        query_range(tiers, "", {}, at(0), at(1))
    with pytest.raises(ValueError):
        query_range(tiers, "cpu", {}, at(1), at(0))


def test_arguments():
    assert [auto_tier(x) for x in (3600, 3601, 604800, 604801)] == ["raw", "minute", "minute", "hour"]
    assert check_tier(None) == check_tier("") == "raw"
    assert parse_label_filter("a=1,b=x=y") == {"a": "1", "b": "x=y"} and parse_label_filter("") == {}
    for bad in (lambda: check_tier("day"), lambda: parse_label_filter("a")):
        with pytest.raises(ValueError):
            bad()


def test_day_bounds_prune_directories(spark, tmp_path):
    from sparktide.sinks.lake import write_samples
    s = samples(spark, [("cpu", CPU, d * 86400 + 5, d) for d in range(4)])
    write_samples(s, str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    q = query_range({"raw": table}, "cpu", None, at(86400), at(2 * 86400), ordered=False)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "ts_day" in plan.split("PartitionFilters:")[1].split("]")[0]
    pushed = plan.split("PushedFilters:")[1]
    assert "EqualTo(name,cpu)" in pushed and "GreaterThanOrEqual(ts" in pushed
    assert [r.value for r in q.collect()] == [1]


def test_sizing(spark):
    s = samples(spark, [("cpu", CPU, i, i) for i in range(120)])
    rows = {r.tier: r for r in sizing_report(s, rollup(s, 60), rollup(s, 3600)).collect()}
    assert (rows["raw"].points, rows["raw"].bytes) == (120, 1920)
    assert (rows["minute"].points, rows["hour"].points) == (6, 3)
    assert rows["raw"].planned_points_per_series == 480
    assert rows["minute"].planned_bytes == 3 * 16 * 7 * 1440
    assert tier_points(0, 60) == 0


def test_union(spark):
    a = samples(spark, [("cpu", CPU, 0, 1)])
    assert union_sources(a, samples(spark, [("mem", {}, 0, 2)]).drop("anomalous")).count() == 2


def test_hours_from_minutes(spark):
    from sparktide.operators.rollup import bucket_parts, coarser_parts, rollup_of
    rng = random.Random(1)
    s = samples(spark, [("cpu", {"h": h}, rng.randint(0, 20_000), rng.random()) for h in "ab" for _ in range(300)] + [("cpu", CPU, 0, float("nan"))])
    def key(rows):
        return sorted((r.series_id, r.bucket, repr(r.min), repr(r.max), f"{r.avg:.9f}") for r in rows.collect())
    assert key(rollup_of(coarser_parts(bucket_parts(s, 60), 3600))) == key(rollup(s, 3600))


def test_no_window_holds_a_whole_hot_series(spark):
    from sparktide.plans.slices import with_rows_before, with_time_before
    rows = spark.range(50_000).select(
        F.lit("hot").alias("series_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.col("id").cast("double").alias("value"))
    near = with_rows_before(rows, ["series_id"], ["ts"], ["value"], 8, 3600)
    assert near.groupBy("series_id", "slice").count().agg(F.max("count")).first()[0] <= 3600 + 8
    assert near.where("is_context").groupBy("slice").count().agg(F.max("count")).first()[0] == 8
    back = with_time_before(rows, 300, 3600)
    assert back.groupBy("series_id", "slice").count().agg(F.max("count")).first()[0] <= 3600 + 301
    assert near.where("NOT is_context").count() == back.where("NOT is_context").count() == 50_000


def test_tiers_grow_call_by_call(spark, tmp_path):
    """Repeated seconds, a bucket fed twice, minutes pruned in between, the open bucket."""
    path = str(tmp_path / "t")
    one = samples(spark, [("m", {"h": "a"}, t, v) for t, v in ((0, 1), (30, 3), (3600, 10), (3610, 20))])
    two = samples(spark, [("m", {"h": "a"}, t, v, 10 + k) for k, (t, v) in enumerate(((3610, 99), (3620, 30), (7200, 5)))])
    append_tiers(one, path)
    minutes = spark.read.parquet(f"{path}/minute")
    assert sorted((r.start % 86400, r.total) for r in minutes.collect()) == [(0, 4), (3600, 30)]
    for day in os.listdir(f"{path}/minute"):
        if day.startswith("ts_day="):
            shutil.rmtree(f"{path}/minute/{day}")
    made = append_tiers(two, path)
    assert [(rel(r.ts), r.value) for r in made["raw"].orderBy("ts").collect()] == [(0, 1), (30, 3), (3600, 10), (3610, 20), (3620, 30), (7200, 5)]
    hours = [(rel(r.bucket), r.min, r.avg, r.max) for r in made["hour"].orderBy("bucket").collect()]
    assert hours == [(0, 1, 2, 3), (3600, 10, (10 + 20 + 99 + 30) / 4, 99)]
    assert [(rel(r.bucket), r.max) for r in made["minute"].orderBy("bucket").collect()] == [(3600, 99)]
    late = samples(spark, [("m", {"h": "a"}, 40, 8, 90), ("m", {"h": "b"}, 10800, 1, 91)])
    made = append_tiers(late, path)
    assert made["raw"].where("labels.h = 'a'").count() == 6
    assert [(rel(r.bucket), r.max) for r in made["hour"].where("labels.h = 'a'").orderBy("bucket").collect()] == [(0, 8), (3600, 99)]
    assert not [d for d in os.listdir(path) if "merge" in d]


def test_bounds_reach_the_scans_of_the_tiers(spark, tmp_path):
    rows = [(n, {"h": "a"}, 86400 * d + 60 * k, k) for n in ("m", "n") for d in range(3) for k in range(5)]
    made = append_tiers(samples(spark, rows), str(tmp_path / "t"))
    for tier in ("raw", "minute", "hour"):
        found = query_range(made, "m", None, at(86400), at(86400 + 3600), tier)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(ts_day" in plan and "EqualTo(name,m)" in plan, tier


def test_carries_are_few_where_arrival_is_the_time(spark):
    rows = spark.range(5000).select(
        F.lit("m").alias("name"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.col("id").cast("double").alias("value"))
    plain = normalize_samples(rows)
    carries = arrival_carries(plain, arrivals_slice(plain))
    assert carries.count() <= 2 and dedup_ordered(plain).count() == 5000
    known = spark.createDataFrame([("m", "m{}", 1_700_000_099)], "name string, series_id string, sec long")
    assert dedup_ordered(plain, newest=known).count() == 4900
