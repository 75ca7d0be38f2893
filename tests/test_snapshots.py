"""Calls that are snapshots: repeated and failed calls, streams into tiers, the series index, compaction."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from helpers import at, rel, samples
from sparktide.operators.export import lake_rows
from sparktide.operators.index import find_series, index_rows, indexed_metrics, indexed_series, of_series
from sparktide.operators.rollup import rollup
from sparktide.operators.select import list_metrics, list_series, select_series
from sparktide.operators.store import store_points
from sparktide.plans.tiers import empty_series, indexed_range, query_range
from sparktide.sinks import lake
from sparktide.sinks.lake import append_lake, append_tiers, compact_tiers, read_lake, read_tiers, stream_tiers
from sparktide.sinks.snapshots import Snapshots


def two_days(spark, n=200):
    rng = random.Random(4)
    rows = [(rng.choice(["cpu", "mem"]), {"host": rng.choice("abc"), "os": "x"} if rng.random() < 0.7 else {}, rng.randint(80_000, 95_000), rng.random()) for _ in range(n)]
    rows.sort(key=lambda r: r[2] // 2000)
    return samples(spark, rows)


def content(tiers):
    """All rows of all tables, as comparable values."""
    raw = sorted((r.series_id, r.sec, r.value) for r in tiers["raw"].collect())
    rolled = [sorted((r.series_id, rel(r.bucket), r.min, round(r.avg, 9), r.max) for r in tiers[t].collect()) for t in ("minute", "hour")]
    return raw, rolled, sorted((r.name, r.key, r.value, r.series_id) for r in tiers["series"].collect())


def expected(s):
    raw = sorted((r.series_id, r.sec, r.value) for r in store_points(s).collect())
    rolled = [sorted((r.series_id, rel(r.bucket), r.min, round(r.avg, 9), r.max) for r in rollup(s, w, closed_only=True).collect()) for w in (60, 3600)]
    return raw, rolled, sorted((r.name, r.key, r.value, r.series_id) for r in index_rows(s.select("name", "series_id").distinct()).collect())


def calls(s, n=3, total=200):
    return [s.where((F.col("seq") >= total * k // n) & (F.col("seq") < total * (k + 1) // n)) for k in range(n)]


def test_a_call_that_fails_anywhere_can_be_repeated(spark, tmp_path, monkeypatch):
    s = two_days(spark)
    one, two = calls(s, 2)
    append_tiers(one, str(tmp_path), call=1)
    before = content(read_tiers(spark, str(tmp_path)))
    write, commit, failed = Snapshots.write, Snapshots.commit, 0
    for broken in ("raw", "minute", "hour", "series", "newest", "commit"):
        def failing(self, table, rows, part, *keys, broken=broken):
            write(self, table, rows, part, *keys)
            if table == broken:
                raise OSError("disk is gone")  # after it has written

        def no_commit(*_):
            raise OSError("disk is gone")

        monkeypatch.setattr(Snapshots, "write", failing)
        if broken == "commit":
            monkeypatch.setattr(Snapshots, "commit", no_commit)
        with pytest.raises(OSError):
            append_tiers(two, str(tmp_path), call=2)
        monkeypatch.setattr(Snapshots, "write", write)
        monkeypatch.setattr(Snapshots, "commit", commit)
        failed += 1
        assert Snapshots(spark, str(tmp_path)).latest().number == 1
    assert content(read_tiers(spark, str(tmp_path))) == before
    assert content(append_tiers(two, str(tmp_path), call=2)) == expected(s)
    assert Snapshots(spark, str(tmp_path)).vacuum(1) >= failed
    assert content(append_tiers(two, str(tmp_path), call=2)) == expected(s)  # made already
    assert content(append_tiers(one, str(tmp_path), call=1)) == expected(s)
    assert Snapshots(spark, str(tmp_path)).latest().number == 2


def test_two_writers_do_not_lose_rows(spark, tmp_path):
    s = two_days(spark, 60)
    store = Snapshots(spark, str(tmp_path))
    append_tiers(s, str(tmp_path), writer="a")
    base = store.latest()
    append_tiers(samples(spark, [("new", {}, 95_100, 1)]), str(tmp_path), writer="b")
    with pytest.raises(RuntimeError):
        store.commit(base, base, 2, "a")
    assert store.latest().calls == {"a": 1, "b": 1}


def test_days_are_pruned_by_a_snapshot(spark, tmp_path):
    s = two_days(spark)
    before = append_tiers(s, str(tmp_path))
    store = Snapshots(spark, str(tmp_path))
    hours = before["hour"].count()
    store.prune({"minute": date(2024, 1, 2)})
    after = read_tiers(spark, str(tmp_path))
    assert {str(r.ts_day) for r in after["minute"].select("ts_day").collect()} == {"2024-01-02"} and after["hour"].count() == hours
    assert before["minute"].count() > after["minute"].count()  # a reader keeps its snapshot
    assert store.vacuum(1) == 1 and read_tiers(spark, str(tmp_path))["raw"].count() == store_points(s).count()


def test_empty_calls(spark, tmp_path):
    s = two_days(spark, 50)
    none = append_tiers(s.limit(0), str(tmp_path))
    assert [none[t].count() for t in ("raw", "minute", "hour", "series")] == [0, 0, 0, 0]
    append_tiers(s, str(tmp_path))
    assert content(append_tiers(s.limit(0), str(tmp_path))) == expected(s)
    assert Snapshots(spark, str(tmp_path)).latest().number == 3


def test_stream_into_tiers_equals_batch(spark, tmp_path):
    s = two_days(spark)
    for part in calls(s, 4):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(checkpoint):
        stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        (stream.writeStream.foreachBatch(stream_tiers(str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / checkpoint))
         .trigger(availableNow=True).start().awaitTermination(300))

    run("cp")
    want = expected(s)
    assert content(read_tiers(spark, str(tmp_path / "t"))) == want
    run("cp")  # nothing new
    store = Snapshots(spark, str(tmp_path / "t"))
    assert store.latest().number == 4 and list(store.latest().calls.values()) == [4] and "" not in store.latest().calls
    assert compact_tiers(spark, str(tmp_path / "t")) == 2
    assert content(read_tiers(spark, str(tmp_path / "t"))) == want
    assert store.vacuum(1) > 0 and content(read_tiers(spark, str(tmp_path / "t"))) == want
    assert all(len(parts) == 1 for parts in store.latest().live["raw"].values()) and compact_tiers(spark, str(tmp_path / "t")) == 0


def test_a_batch_that_is_run_again_is_one_call(spark, tmp_path, monkeypatch):
    s = two_days(spark, 80)
    s.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = lake.append_tiers

    def run(fails):
        def once(*args, **more):
            made(*args, **more)
            if fails:
                raise OSError("died after the commit")

        monkeypatch.setattr(lake, "append_tiers", once)
        stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
        q = (stream.writeStream.foreachBatch(stream_tiers(str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
        try:
            q.awaitTermination(300)
        except Exception:  # noqa: BLE001 - the failure above
            assert fails

    run(True)
    run(False)
    assert content(read_tiers(spark, str(tmp_path / "t"))) == expected(s)
    assert Snapshots(spark, str(tmp_path / "t")).latest().number == 1


@pytest.mark.parametrize("labels", [None, {"host": "a"}, {"host": ""}, {"host": "a", "os": "x"}, {"gone": ""}, {"gone": "x"}, {"host": "b", "gone": ""}])
def test_index_finds_what_a_scan_finds(spark, labels):
    s = two_days(spark)
    index = index_rows(s.select("name", "series_id").distinct())
    for name in (None, "cpu", "disk"):
        got = sorted(tuple(r) for r in find_series(index, name, labels).collect())
        assert got == sorted(tuple(r) for r in select_series(s, name, labels).select("name", "series_id").distinct().collect())
    found = find_series(index, "cpu", labels)
    assert of_series(s, found).count() == select_series(s, "cpu", labels).count()


def test_index_answers_without_points(spark, tmp_path, monkeypatch):
    s = two_days(spark)
    tiers = append_tiers(s, str(tmp_path))
    assert [r.series_id for r in indexed_series(tiers["series"]).collect()] == [r.series_id for r in list_series(s).collect()]
    assert [r.name for r in indexed_metrics(tiers["series"], "c").collect()] == [r.name for r in list_metrics(s, "c").collect()] == ["cpu"]
    plan = indexed_series(tiers["series"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(key,)" in plan and "ReadSchema: struct<name:string,key:string,series_id:string>" in plan
    want = query_range(tiers, "cpu", {"host": "a"}, at(80_000), at(90_000)).collect()
    assert indexed_range(tiers, "cpu", "host=a", at(80_000), at(90_000)).collect() == want and want
    plan = indexed_range(tiers, "cpu", "host=a", at(80_000), at(90_000))._jdf.queryExecution().executedPlan().toString()
    assert "In(series_id" in plan or "EqualTo(series_id" in plan
    monkeypatch.setattr("sparktide.operators.index.MAX_LISTED", 0)
    assert indexed_range(tiers, "cpu", "host=a", at(80_000), at(90_000)).collect() == want
    gone = empty_series(tiers, "cpu", {"host": "a"}, at(0), at(10)).collect()
    assert [r.series_id for r in gone] == ['cpu{host="a",os="x"}']


def test_lake_calls(spark, tmp_path):
    m = rollup(two_days(spark), 60)
    rows = lake_rows(m, "n1", "h1").unionByName(lake_rows(m, "n2", "h2"))
    assert read_lake(spark, str(tmp_path)) is None
    append_lake(rows.where("ts_day < '2024-01-02'"), str(tmp_path), call=1)
    append_lake(rows.where("ts_day < '2024-01-02'"), str(tmp_path), call=1)
    append_lake(rows.where("ts_day >= '2024-01-02'"), str(tmp_path))
    append_lake(rows.limit(0), str(tmp_path))
    got = read_lake(spark, str(tmp_path))
    order = ["node_id", "metric_name", "labels_json", "ts"]
    assert got.select(*rows.columns).orderBy(*order).collect() == rows.orderBy(*order).collect()
    plan = got.where("node_id = 'n1' AND ts_day = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "node_id" in plan


def test_a_raw_tier_that_is_off_has_the_columns_of_points(spark):
    s = two_days(spark, 10)
    found = query_range({"raw": None, "minute": rollup(s, 60)}, "cpu", {}, at(0), at(9))
    assert found.columns == store_points(s).columns and found.count() == 0
