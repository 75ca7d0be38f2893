"""Vector codes against a plain version in Python integers."""

import math
import random

import pytest

from sparktide.llm import vector_codes
from sparktide.llm.vector_codes import compress_vectors

KIND = "vec_id long, embedding array<float>, label int, code string, _label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """[(id, code, error, label error)] and the codebooks for (id, vector, label) rows."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    ints = [[max(-(1 << 27), min(1 << 27, math.floor(4096 * x))) for x in r[1]] for r in rows]
    size = -(-len(ints[0]) // parts)
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            to = [best(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, t in zip(cut, to, strict=True) if t == k]
                if own:
                    books[p] = [*books[p][:k], [sum(x) // len(own) for x in zip(*own, strict=True)], *books[p][k + 1 :]]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    out = [(r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]]) for r, f, e in zip(rows, found, error, strict=True)]
    return out, ",".join(str(x) for b in books for e in b for x in e)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 9) for i, v, label in rows], KIND)


def vectors(n, dims, seed=5):
    """As 32-bit floats, a third of them with one label."""
    import numpy as np

    rnd = random.Random(seed)
    return [(i, [float(np.float32(rnd.gauss(rnd.choice([-1, 0, 2]), 0.3))) for _ in range(dims)], rnd.choice([1, 1, None, 2, 3])) for i in rnd.sample(range(10 * n), n)]


@pytest.mark.parametrize("block,dims", [(4096, 16), (7, 16), (4096, 21)])
def test_against_plain(spark, monkeypatch, block, dims):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    rows = vectors(150, dims)
    got = compress_vectors(frame(spark, rows).repartition(5)).collect()
    want, books = plain(rows)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(want)
    assert {r.codebooks for r in got} == {books}


def test_odd_rows(spark):
    fine = vectors(20, 8)
    odd = [(-1, None, 1), (-2, [None] * 8, 1), (-3, [math.nan] * 8, 1), (-4, [math.inf] + [0.0] * 7, None), (-5, [-math.inf] * 8, 2)]
    ties = [fine[3], fine[3], (None, fine[4][1], None), (5000, [1e9] * 8, 2)]
    got = compress_vectors(frame(spark, fine + odd + ties)).collect()
    want, books = plain(fine + ties)
    key = lambda r: (r[0] is None, *r)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=key) == sorted(want, key=key)
    assert got[0].codebooks == books
    other = compress_vectors(frame(spark, [*fine, (10**6, [0.5] * 7, 1)])).collect()
    assert len(other) == len(fine)  # another length than the first vector's


def test_few_and_none(spark):
    few = vectors(3, 8)
    got = compress_vectors(frame(spark, few)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(plain(few)[0])
    assert all(r.error == 0 for r in got)
    none = compress_vectors(frame(spark, few).limit(0))
    assert none.collect() == [] and none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks"]
    empty = compress_vectors(frame(spark, [(1, [], 1), (2, [], None)])).collect()
    assert [(r.code, r.error, r.codebooks) for r in empty] == [("00" * 8, 0, "")] * 2
    with pytest.raises(ValueError):
        compress_vectors(frame(spark, few), entries=257)
