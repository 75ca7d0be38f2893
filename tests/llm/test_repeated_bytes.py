"""Suffix arrays and repeated byte strings against plain versions."""

import random

import numpy as np
import pytest

from sparktide.llm import repeated_bytes as module
from sparktide.llm.repeated_bytes import repeated_bytes
from sparktide.llm.suffix_array import common_prefixes, suffix_array

KIND = "doc_id long, text string, n_bytes string, anchor int"


def plain(rows, length):
    """[(id, bytes, removed, runs, kept)] of (id, text) rows in their order."""
    first, out = set(), []
    for i, text in rows:
        raw = (text or "").encode()
        gone = set()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in first:
                gone.update(range(k, k + length))
            first.add(s)
        runs = sum(k - 1 not in gone for k in gone)
        out.append((i, len(raw), len(gone), runs, bytes(b for k, b in enumerate(raw) if k not in gone)))
    return out


def result(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in frame.collect()), key=str)


def texts(seed=2, n=50):
    rnd = random.Random(seed)
    letters = "abcdefghijklmnop éß漢 \n\0"
    make = lambda m: "".join(rnd.choice(letters) for _ in range(m))
    shared = [make(rnd.randint(40, 300)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [make(rnd.randint(0, 120)) for _ in range(3)]
        for _ in range(rnd.randint(0, 4)):
            s = rnd.choice(shared)
            parts.insert(rnd.randint(0, len(parts)), s[rnd.randint(0, 30) :])
        rows.append((i, "".join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, "a" * 700), (n + 2, "ab" * 300), (n + 3, shared[0] * 3), (n + 4, "é" * 200), (n + 5, ""), (n + 6, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], KIND).repartition(3)


@pytest.mark.parametrize("length,batch,shard,array,hot", [(100, 4_000_000, 2_000_000, 2_000_000, 40_000), (100, 1500, 2000, 3000, 40_000), (60, 1500, 900, 1, 3), (40, 3000, 2000, 5000, 0)])
def test_against_plain(spark, monkeypatch, length, batch, shard, array, hot):
    monkeypatch.setattr(module, "BATCH_BYTES", batch)
    monkeypatch.setattr(module, "SHARD_BYTES", shard)
    monkeypatch.setattr(module, "ARRAY_BYTES", array)
    rows = texts()
    assert result(repeated_bytes(frame(spark, rows), length, hot_spans=hot)) == sorted(plain(rows, length), key=str)


def test_odd_rows(spark, monkeypatch):
    p = "".join(random.Random(1).choices("abcdefgh", k=150))
    rows = [(5, p), (5, p), (3, "x" + p), (None, p), (None, None), (9, p[:99])]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in repeated_bytes(frame(spark, rows)).collect())
    assert got == [(3, 0), (5, 150), (5, 150), (9, 0), (99, 0), (99, 150)]
    twice = sorted(r.n_removed for r in repeated_bytes(frame(spark, [(5, p), (5, p)])).collect())
    assert twice == [0, 150]
    none = repeated_bytes(frame(spark, rows).limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "n_bytes", "n_removed", "removed", "kept"]
    with pytest.raises(ValueError):
        repeated_bytes(frame(spark, rows), 39)


def test_long_text(spark):
    """A text of several pieces, with a copy of its middle in another one."""
    rnd = np.random.default_rng(3)
    long = "".join(chr(97 + x) for x in rnd.integers(0, 20, 1_600_000))
    rows = [(1, long), (2, "y" + long[500_000:600_000] + "z"), (3, long[1_599_000:] + long[:200])]
    got = result(repeated_bytes(frame(spark, rows)))
    assert [(r[0], r[2], r[3], r[4]) for r in got[1:]] == [(2, 100_000, 1, b"yz"), (3, 1200, 1, b"")]
    assert got[0][2] == 0


def test_suffix_arrays():
    rnd = random.Random(0)
    for _ in range(300):
        letters = rnd.choice([1, 2, 3, 26])
        raw = b"\0".join(bytes(rnd.randint(1, letters) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 5))) + b"\0"
        text = np.frombuffer(raw, np.uint8)
        array = suffix_array(text)
        assert array.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        ends = np.flatnonzero(text == 0)
        room = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
        got = common_prefixes(text, array, room)
        for a, b in zip(array[1:].tolist(), array[:-1].tolist(), strict=True):
            want = 0
            while want < min(room[a], room[b]) and raw[a + want] == raw[b + want]:
                want += 1
            assert got[a] == want
        short = suffix_array(text, depth=4)
        assert [raw[i : i + 4] for i in short] == [raw[i : i + 4] for i in array]
