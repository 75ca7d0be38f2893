"""Lake table, matrix results, batches, text, streams and fan-out."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import at, rel, samples
from sparktide.operators.export import delta_since, delta_watermark, federated_query, local_source
from sparktide.operators.rollup import rollup
from sparktide.operators.select import latest_per_series
from sparktide.operators.store import dedup_ordered
from sparktide.sinks.fanout import fan_out
from sparktide.sinks.lake import write_lake
from sparktide.sinks.matrix import empty_matrix, matrix_result, timeseries_batches
from sparktide.sinks.text import render_exposition, write_exposition
from sparktide.sources.remote_write import decode_remote_write
from sparktide.streaming.export import start_export, stream_export, stream_forward
from sparktide.streaming.paths import shared_folder
from sparktide.streaming.rollups import stream_dedup, stream_rollup

CPU = {"host": "a"}
TEN = [10, 20, 30, 40, 1, 2, 3, 4, 99]


def minutes(spark):
    return rollup(samples(spark, [("cpu", CPU, 15 * i, v) for i, v in enumerate(TEN)]), 60, closed_only=True)


def test_delta_is_open_below(spark):
    rows = delta_since(minutes(spark), at(0), at(600), "n1", "h1")
    got = rows.collect()
    assert [(rel(r.ts), r.value, r.anomaly_bit, r.labels_json) for r in got] == [(60, 2.5, False, '{"host":"a"}')]
    assert rel(delta_watermark(rows, at(0)).first().watermark) == 60
    later = delta_since(minutes(spark), at(9999), None, "n1", "h1")
    assert later.count() == 0 and rel(delta_watermark(later, at(9999)).first().watermark) == 9999
    assert local_source(minutes(spark), "n", "h")(None, None).count() == 2


def test_lake_round_trip(spark, tmp_path):
    path = str(tmp_path / "lake")
    rows = delta_since(minutes(spark), None, None, "n1", "h1").unionByName(delta_since(minutes(spark), None, None, "n2", "h2"))
    write_lake(rows, path)
    write_lake(rows.where(F.lit(False)), path)
    write_lake(rows.where("node_id = 'n1'"), path)
    lake = spark.read.parquet(path)
    assert federated_query(lake, nodes=["n1"]).count() == 4
    once = federated_query(lake, nodes=["n1"], start=at(0), end=at(59), metric="cpu", labels={"host": "a"}, dedupe=True)
    assert [(r.node_id, r.value) for r in once.collect()] == [("n1", 25)]
    assert federated_query(lake, labels={"host": "b"}).count() == 0
    plan = federated_query(lake, nodes=["n1"], start=at(0))._jdf.queryExecution().executedPlan().toString()
    assert "node_id" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_matrix(spark):
    s = samples(spark, [("cpu", CPU, 0, 0.5), ("cpu", CPU, 1.25, 1e6), ("cpu", CPU, 7200, 3)])
    got = [json.loads(r.json) for r in matrix_result(s, start=at(0)).collect()]
    base = int(at(0).timestamp())
    assert got == [{"metric": {"__name__": "cpu", "host": "a"}, "values": [[base, "0.5"], [base + 1.25, "1e+06"], [base + 7200, "3"]]}]
    assert sorted((r.chunk, r.points) for r in matrix_result(s, start=at(0), chunk_s=3600).collect()) == [(0, 2), (2, 1)]
    tier = json.loads(matrix_result(minutes(spark), start=at(0)).first().json)
    assert tier["values"] == [[base, "25"], [base + 60, "2.5"]] and tier["min"][0] == [base, "10"] and tier["max"][1] == [base + 60, "4"]
    none = empty_matrix(s.select("name", "series_id").distinct()).first()
    assert json.loads(none.json) == {"metric": {"__name__": "cpu", "host": "a"}, "values": []}


def test_batches(spark):
    s = samples(spark, [("cpu", CPU, 1, 2), ("cpu", CPU, 0, 1)])
    row = timeseries_batches(s).first()
    assert [(e["key"], e["value"]) for e in row.labels] == [("__name__", "cpu"), ("host", "a")]
    assert [(x.ts_ms - int(at(0).timestamp()) * 1000, x.value) for x in row.samples] == [(0, 1), (1000, 2)]


def test_exposition_text(spark, tmp_path):
    s = samples(spark, [("up", {}, 0, 1), ("cpu", {"b": 'q"\\\n', "a": "1"}, 0, 0.25), ("cpu", {"b": "x"}, 5, 1e7), ("cpu", {"b": "x"}, 6, 2e7)])
    base = int(at(0).timestamp()) * 1000
    want = ["# TYPE cpu untyped", f'cpu{{a="1",b="q\\"\\\\\\n"}} 0.25 {base}', f'cpu{{b="x"}} 2e+07 {base + 6000}', "# TYPE up untyped", f"up 1 {base}"]
    assert [r.line for r in render_exposition(latest_per_series(s)).collect()] == want
    write_exposition(latest_per_series(s), str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == sorted(want)


def run(spark, rows, tmp_path, name):
    (rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp"))
     .trigger(availableNow=True).start().awaitTermination(300))
    return spark.read.parquet(str(tmp_path / name))


def as_stream(spark, df, tmp_path, per_trigger=1):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(str(tmp_path / "in"))


def test_stream_rollup_emits_closed_buckets(spark, tmp_path):
    s = samples(spark, [("cpu", CPU, 15 * i, v) for i, v in enumerate(TEN)])
    s.write.parquet(str(tmp_path / "in"))
    got = run(spark, stream_rollup(as_stream(spark, s, tmp_path, 100), 60, "0 seconds"), tmp_path, "out").orderBy("bucket").collect()
    assert [(rel(r.bucket), r.min, r.avg, r.max, r.labels) for r in got] == [(0, 10, 25, 40, CPU), (60, 1, 2.5, 4, CPU)]


def test_stream_dedup_equals_batch(spark, tmp_path):
    secs = [0, 1, 1, 5, 3, 6, 2, 6, 7, 7, 4, 9]
    s = samples(spark, [("cpu", CPU, t, i) for i, t in enumerate(secs)])
    for lo in (0, 4, 8):
        s.where((F.col("seq") >= lo) & (F.col("seq") < lo + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, stream_dedup(as_stream(spark, s, tmp_path)), tmp_path, "out")
    assert sorted(r.value for r in got.collect()) == sorted(r.value for r in dedup_ordered(s).collect()) == [0, 1, 3, 5, 8, 11]
    assert got.first().labels == CPU


def test_stream_export_goes_on_where_it_stopped(spark, tmp_path):
    m = minutes(spark)
    m.where("bucket < '2024-01-01 00:01:00'").coalesce(1).write.parquet(str(tmp_path / "in"))

    def export():
        start_export(stream_export(as_stream(spark, m, tmp_path), "n1", "h1"), str(tmp_path / "lake"), str(tmp_path / "cp")).awaitTermination(300)
        return spark.read.parquet(str(tmp_path / "lake")).count()

    assert export() == 1 and export() == 1
    m.where("bucket >= '2024-01-01 00:01:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert export() == 2


def test_forward(spark, tmp_path):
    s = samples(spark, [("cpu", CPU, i, i) for i in range(5)])
    s.coalesce(1).write.parquet(str(tmp_path / "in"))

    def deliver(bodies, batch_id):
        bodies.write.mode("overwrite").parquet(str(tmp_path / "bodies"))

    (as_stream(spark, s, tmp_path).writeStream.foreachBatch(stream_forward(deliver)).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination(300))
    back = decode_remote_write(spark.read.parquet(str(tmp_path / "bodies"))).collect()
    assert sorted((rel(r.ts), r.value) for r in back) == [(i, i) for i in range(5)] and back[0].labels == CPU


def test_fan_out(spark):
    df, seen, problems = spark.range(3), [], []

    def broken(batch, batch_id):
        raise RuntimeError("down")

    consumers = {"a": lambda b, i: seen.append(b.count()), "b": broken, "c": lambda b, i: seen.append(b.count())}
    fan_out(consumers, lambda n, i, e: problems.append((n, i, str(e))))(df, 7)
    assert seen == [3, 3] and problems == [("b", 7, "down")]
    with pytest.raises(RuntimeError):
        fan_out(consumers)(df, 8)


def test_shared_folder(spark):
    assert shared_folder(spark, "x").endswith("/x")


def test_batches_are_bounded_in_samples(spark):
    s = samples(spark, [("m", {}, t % 50, t) for t in range(100)])
    rows = timeseries_batches(s, max_samples=30).collect()
    assert sorted((r.piece, len(r.samples)) for r in rows) == [(0, 30), (1, 30), (2, 30), (3, 10)]
    assert sorted(x["value"] for r in rows for x in r.samples) == list(range(100))
    plan = timeseries_batches(s, max_samples=30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
