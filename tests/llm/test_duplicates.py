"""Vectors, passages and n-gram sets against plain versions."""

import random

import numpy as np
import pytest

import brute
from sparktide.llm import embeddings, shingle_join, substring
from sparktide.llm.embeddings import near_vectors
from sparktide.llm.graph import components
from sparktide.llm.shingle_join import near_duplicates, prefix_length
from sparktide.llm.substring import repeated_words

rnd = random.Random(4)
WORDS = [f"w{i}" for i in range(300)]


def text(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def passages():
    shared = [text(rnd.randint(13, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rnd.randint(0, 30)) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(shared))
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, shared[0] + " " + shared[0]), (63, ""), (64, None), (65, "x"), (66, "é ñ " * 40), (67, "é ñ " * 40)]
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in rows], "doc_id long, text string, n_words string, keys int")


@pytest.mark.parametrize("batch,bucket", [(4_000_000, 24_000_000), (400, 900)])
def test_passages_against_plain(spark, monkeypatch, batch, bucket):
    monkeypatch.setattr(substring, "BATCH_BYTES", batch)
    monkeypatch.setattr(substring, "BUCKET_BYTES", bucket)
    rows = passages()
    got = {r.doc_id: r for r in repeated_words(as_docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, kept, removed in brute.substring(rows):
        assert (got[i].n_removed, got[i].kept_text) == (removed, " ".join(kept)), i
        assert sum(r["last"] - r["first"] + 1 for r in got[i].removed) == removed


def test_passages_odd_rows(spark):
    p = text(20)
    rows = [(None, p), (5, p), (5, p), (3, "a " + p), (None, None)]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in repeated_words(as_docs(spark, rows)).collect())
    assert got == [(3, 21, 0), (5, 20, 20), (5, 20, 20), (99, 0, 0), (99, 20, 20)]
    assert repeated_words(as_docs(spark, rows).limit(0)).count() == 0
    carried = repeated_words(as_docs(spark, rows), carry=("keys",))
    assert carried.columns == ["doc_id", "text", "keys", "n_words", "n_removed", "removed", "kept_text"]
    with pytest.raises(ValueError):
        repeated_words(as_docs(spark, rows), window=7)


def copies():
    rows = []
    for _ in range(12):
        base = text(rnd.randint(60, 150)).split()
        for _ in range(rnd.randint(1, 12)):
            w = base[:]
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            rows.append(" ".join(w))
    rows += [rows[0].upper(), rows[0].replace(" ", "\n"), "one", "one", "two words", None, "", "  ", "é " * 30]
    return list(enumerate(rows))


@pytest.mark.parametrize("tile,bundle", [(128, 400), (3, 5)])
def test_joins_against_plain(spark, monkeypatch, tile, bundle):
    monkeypatch.setattr(shingle_join, "BUNDLE", bundle)
    rows = copies()
    links = brute.jaccard_links([t for _, t in rows])
    low = brute.groups(len(rows), links)
    got = {r.doc_id: r for r in near_duplicates(as_docs(spark, rows), tile=tile).collect()}
    assert len(got) == len(rows) and len(links) > 100
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in x for x in links), low[i], low[i] == i), i


def test_joins_odd_rows(spark):
    t = text(30)
    rows = [(7, t), (7, t), (2, t + " end"), (None, "alone here"), (None, t), (9, None)]
    got = near_duplicates(as_docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_links, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(2, 3, 2, True), (7, 3, 2, False), (7, 3, 2, False), (9, 0, 9, True)]
    assert sorted((r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(False, False), (True, True)]
    assert near_duplicates(as_docs(spark, rows).limit(0)).count() == 0


def test_prefix_is_shortened_to_the_recall():
    assert prefix_length(0.8, 40, 10, 0.99999) == 6 and prefix_length(0.8, 40, 10, 0.5) == 10 and prefix_length(0.1, 2, 10, 0.99) == 1


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    rnd.shuffle(path)
    rows = path + [(100, 101), (101, 100), (102, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [512, 4])
def test_vectors_against_plain(spark, tile):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(14):
        base = rng.normal(size=6)
        rows += [((base + rng.normal(size=6) * s).astype("float32").tolist(), c % 3) for s in rng.choice([0.0, 0.02, 0.2, 0.5], 8)]
    rows += [([0.0] * 6, 1), (None, 1), ([], 1), ([1.0, None, 0.0, 0.0, 0.0, 0.0], 1), ([float("nan"), 1.0, 0.0, 0.0, 0.0, 0.0], 1), ([float("inf")] * 6, 1), (rows[0][0], None), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([x * 3 for x in rows[0][0]], 0)]
    n = len(rows)
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) and label is not None for v, label in rows]
    links = [
        (a, b) for a in range(n) for b in range(a) if ok[a] and ok[b] and rows[a][1] == rows[b][1] and len(rows[a][0]) == len(rows[b][0])
        and np.dot(rows[a][0], rows[b][0]) / np.sqrt(np.dot(rows[a][0], rows[a][0]) * np.dot(rows[b][0], rows[b][0])) >= 0.93
    ]
    low = brute.groups(n, links)
    df = spark.createDataFrame([(i, v, y, 0) for i, (v, y) in enumerate(rows)], "vec_id long, embedding array<float>, label int, copies int")
    got = {r.vec_id: r for r in near_vectors(df, tile=tile).collect()}
    assert len(got) == n and len(links) > 50
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in x for x in links), low[i], low[i] == i), i


def test_vectors_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (4, 0, 4, True)]
    assert near_vectors(df.limit(0)).count() == 0


def test_products_are_given_up_but_none_is_lost():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 24))
    y = x[:90] + rng.normal(size=(90, 24)) * 0.25
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    i, j = embeddings.near_pairs(x, y, axes, 0.93)
    c = (x @ y.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))[None, :]
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(c >= 0.93)), strict=True))
