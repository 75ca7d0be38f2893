"""Feature vectors, models, scores, ranking; batch and streaming."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at, rel, samples
from sparktide.operators import anomaly as M
from sparktide.schema import MODELS


def naive_features(values, diff_n, smooth_n, lag_n):
    d = [values[i + diff_n] - values[i] for i in range(len(values) - diff_n)] if diff_n else list(values)
    n = max(smooth_n, 1)
    m = [sum(d[i:i + n]) / n for i in range(len(d) - n + 1)]
    return [m[i:i + lag_n + 1] for i in range(len(m) - lag_n)]


def naive_model(vectors):
    """Two-centroid fit with all its rounds, element by element."""
    def dist(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5

    c = [list(vectors[0]), None]
    best = -1.0
    for v in vectors:
        if dist(v, c[0]) > best:
            best, c[1] = dist(v, c[0]), list(v)
    for _ in range(60):
        side = [0 if dist(v, c[0]) <= dist(v, c[1]) else 1 for v in vectors]
        for k in (0, 1):
            mine = [v for v, s in zip(vectors, side) if s == k]
            if mine:
                c[k] = [sum(x) / len(mine) for x in zip(*mine)]
    d = [(dist(v, c[0]) + dist(v, c[1])) / 2 for v in vectors]
    return c[0], c[1], min(d), max(d)


@pytest.mark.parametrize("settings", [(1, 3, 5), (0, 0, 3), (1, 1, 2), (0, 4, 1)])
@pytest.mark.parametrize("slice_s", [13, 100_000])
def test_vectors_equal_the_naive_form(spark, settings, slice_s):
    rng = random.Random(1)
    t, rows = 0, []
    for i in range(80):
        t += rng.choice([1, 5, 40])
        rows.append((t, rng.random() * 100))
    got = M.feature_vectors(samples(spark, [("c", {}, t, v) for t, v in rows]), *settings, slice_s=slice_s).orderBy("ts").collect()
    want = naive_features([v for _, v in rows], *settings)
    assert len(got) == len(want)
    assert np.allclose([r.x for r in got], want)
    need = M.values_needed(*settings)
    assert rel(got[0].ts) == rows[need - 1][0]


def test_unit_vectors(spark):
    s = samples(spark, [("c", {}, i, i) for i in range(1, 11)])
    assert {tuple(r.x) for r in M.feature_vectors(s, 1, 3, 2).collect()} == {(1.0, 1.0, 1.0)}
    assert M.feature_windows(np.arange(1.0, 6), 0, 0, 2).tolist() == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert len(M.feature_windows(np.array([1.0]), 1, 0, 1)) == 0


@pytest.mark.parametrize("early", [True, False])
def test_two_clusters(spark, early):
    j = [0, 0.1, -0.1, 0.2, -0.2]
    v = np.array([[j[i % 5]] * 3 for i in range(20)] + [[100 + j[i % 5]] * 3 for i in range(20)])
    c0, c1, lo, hi = M._fit(v, 500, early)
    assert np.allclose(c0, 0, atol=0.3) and np.allclose(c1, 100, atol=0.3)
    models = spark.createDataFrame([("s", at(0), c0.tolist(), c1.tolist(), lo, hi)], MODELS)
    x = spark.createDataFrame([([0.15] * 3,), ([99.85] * 3,), ([500.0] * 3,)], "x array<double>")
    d = M.mean_distance(F.col("x"), F.col("c0"), F.col("c1"))
    scores = [r.s for r in x.crossJoin(models).select(M.anomaly_score(d, F.col("min_dist"), F.col("max_dist")).alias("s")).collect()]
    assert scores[0] < 99 and scores[1] < 99 and scores[2] >= 99


def test_early_stop_changes_nothing():
    rng = np.random.default_rng(3)
    for _ in range(20):
        v = rng.normal(size=(60, 6)).cumsum(axis=0)
        a, b, n = M._fit(v, 500, True), M._fit(v, 500, False), naive_model(v.tolist())
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
        assert np.allclose(a[0], n[0]) and np.allclose(a[1], n[1]) and np.allclose(a[2:], n[2:])


def test_a_fit_holds_its_vectors_once():
    """Distances are taken in pieces, with the same bits as at once."""
    values = np.random.default_rng(6).normal(size=300_000)
    v = np.lib.stride_tricks.sliding_window_view(values, 6)
    tracemalloc.start()
    try:
        found = M._fit(v, 2, True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.9 * v.size * 8
    reach = sum(np.sqrt(((v.T - c[:, None]) ** 2).sum(axis=0)) for c in found[:2]) / 2
    assert found[2:] == (reach.min(), reach.max())


def test_training_uses_only_its_window(spark):
    rng = random.Random(4)
    rows = [("c", {"h": h}, 10 * i, rng.random()) for h in "ab" for i in range(100)] + [("short", {}, 10 * i, i) for i in range(9)]
    s = samples(spark, rows)
    got = {(r.series_id, rel(r.trained_at)): r for r in M.train_models(s, train_at=[at(400), at(990)], window_s=400).collect()}
    assert set(got) == {(f'c{{h="{h}"}}', float(t)) for h in "ab" for t in (400, 990)}
    for h in "ab":
        for t in (400, 990):
            vals = [v for n, lab, sec, v in rows if n == "c" and lab["h"] == h and t - 400 <= sec <= t]
            want = naive_model(naive_features(vals, 1, 3, 5))
            r = got[f'c{{h="{h}"}}', float(t)]
            assert np.allclose(r.c0, want[0]) and np.allclose(r.c1, want[1])
            assert (r.min_dist, r.max_dist) == pytest.approx(want[2:])


def test_grid_equals_listed_times(spark):
    rng = random.Random(6)
    s = samples(spark, [("c", {}, 7 * i, rng.random()) for i in range(300)])
    grid = M.train_models(s, every_s=600, start=at(600), end=at(1900), window_s=900)
    listed = M.train_models(s, train_at=[at(600), at(1200), at(1800)], window_s=900)
    assert sorted(grid.collect()) == sorted(listed.collect()) and grid.count() == 3


def test_constant_series_never_anomalous(spark):
    s = samples(spark, [("c", {}, i, 5) for i in range(60)] + [("c", {}, 60 + i, 1000 * i) for i in range(10)])
    models = M.train_models(s, train_at=[at(59)], window_s=59)
    assert M.score_samples(s, models).where("anomalous").count() == 0


def test_spike(spark):
    rng = random.Random(2)
    rows = [("c", {}, i, 10 + rng.random() * 0.4 - 0.2) for i in range(50)]
    rows += [("c", {}, 50 + i, 10.1) for i in range(4)] + [("c", {}, 54 + i, 100000) for i in range(4)]
    s = samples(spark, rows)
    opts = dict(diff_n=0, smooth_n=0, lag_n=3)
    models = M.train_models(s, train_at=[at(49.5)], window_s=60, **opts)
    got = [(rel(r.ts), r.anomalous) for r in M.score_samples(s, models, **opts).orderBy("ts").collect()]
    assert len(got) == 58 and not any(a for t, a in got if t <= 53) and got[-1][1]


def naive_scores(points, models, count, threshold=99.0):
    """points: (t, v); models: (trained, c0, c1, lo, hi) of the one series."""
    out = []
    for i, (t, _) in enumerate(points):
        window = [v for _, v in points[max(0, i - 8):i + 1]]
        live = [m for m in sorted(models) if m[0] <= t][-count:]
        if len(window) < 9 or not live:
            out.append(False)
            continue
        x = naive_features(window, 1, 3, 5)[-1]
        flags = []
        for _, c0, c1, lo, hi in live:
            d = (np.linalg.norm(np.subtract(x, c0)) + np.linalg.norm(np.subtract(x, c1))) / 2
            flags.append((0 if hi == lo else min(100, 100 * abs((d - lo) / (hi - lo)))) >= threshold)
        out.append(all(flags))
    return out


@pytest.mark.parametrize("slice_s", [150, 100_000])
def test_votes_use_the_models_of_their_time(spark, slice_s):
    rng = random.Random(8)
    t, points = 0, []
    for i in range(300):
        t += rng.choice([5, 10, 20])
        points.append((t, rng.gauss(0, 1) * (30 if 150 < i < 160 or i % 40 == 0 else 1)))
    s = samples(spark, [("c", {}, t, v) for t, v in points])
    models = M.train_models(s, train_at=[at(x) for x in range(300, 3000, 200)], window_s=300)
    plain = [(rel(m.trained_at), m.c0, m.c1, m.min_dist, m.max_dist) for m in models.collect()]
    got = [r.anomalous for r in M.score_samples(s, models, model_count=3, slice_s=slice_s).orderBy("ts").collect()]
    want = naive_scores(points, plain, 3)
    assert got == want and any(want)


def test_ensembles_are_capped(spark):
    rows = [("s", at(i), [0.0], [1.0], 0.0, float(i)) for i in range(5)]
    models = spark.createDataFrame(rows, MODELS)
    assert sorted(r.max_dist for r in M.newest_models(models, 2).collect()) == [3, 4]
    assert [len(r.models) for r in M.ensembles(models, 2).orderBy("since").collect()] == [1, 2, 2, 2, 2]


def test_ranking(spark):
    rows = [("noisy", {}, t, 1, None, True) for t in (50, 55)] + [("clean", {}, t, 1) for t in (50, 55)]
    rows += [("mixed", {}, t, 1, None, t == 50) for t in (50, 52, 54, 56)] + [("old", {}, 0, 1, None, True)]
    got = M.anomaly_ranking(samples(spark, rows), at(60), 30).collect()
    assert [(r.name, r.rate, r["count"]) for r in got] == [("noisy", 1.0, 2), ("mixed", 0.25, 4)]
    with pytest.raises(ValueError):
        M.anomaly_ranking(samples(spark, rows), at(60), 0)


@pytest.mark.parametrize("bad", [
    dict(model_count=0), dict(training_window_s=0), dict(retrain_interval_s=0), dict(diff_n=2), dict(smooth_n=-1), dict(lag_n=0),
    dict(score_threshold=0), dict(score_threshold=101),
])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        M.check_settings(**bad)


def test_streaming_scores_equal_batch(spark, tmp_path):
    from sparktide.streaming.scoring import retrain, stream_score
    rng = random.Random(9)
    s = samples(spark, [("c", {"h": h}, 5 * i, rng.gauss(0, 40 if i % 50 == 0 else 1)) for h in "ab" for i in range(200)])
    retrain(s, str(tmp_path / "m"), at(400), window_s=400)
    models = spark.read.parquet(str(tmp_path / "m"))
    assert models.count() == 2
    cut = int(at(600).timestamp())
    for part in (F.col("sec") < cut, F.col("sec") >= cut):
        s.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (stream_score(stream, models).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r.series_id, r.ts): r.anomalous for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.series_id, r.ts): r.anomalous for r in M.score_samples(s, models).collect()}
    assert got == want and any(want.values())
