"""Quality: learned vectors of hashed word and character n-grams, averaged over a document, with a softmax on top.

Trained by stochastic gradient descent in numpy on a bounded sample.  Both layers are linear, so for scoring they fold
into one number for each n-gram.  A word that repeats the one before it is written as a repeat mark, and so is each of
its characters, so that a loop of one word looks alike for all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.llm.labelled import remainder, sample_by_label
from sparktide.llm.points import code_points, grams, row_sums
from sparktide.llm.shared import text_slices
from sparktide.llm.words import Family, spans

#: Texts of each label that are learned from, and characters that such a text has at most.
TRAIN_TEXTS, TRAIN_CHARS = 1200, 12_000
BITS, SIZE, EPOCHS, BATCH, RATE = 16, 8, 8, 32, 0.1
#: Lengths of character n-grams; words are taken alone and in pairs.
LENGTHS = (2, 3)
SLICE = 1 << 19

_word = Family(41)
REPEAT, REPEAT_SIGN = np.uint64(0x51ED270B), np.uint32(0xE000)


def features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, edges of the rows among them) for each kind of n-gram of a slice."""
    rows = len(offsets) - 1
    start, end, row = spans(raw, offsets)
    word = _word.words(raw, start, end)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    word[same] = REPEAT
    edge = np.searchsorted(row, np.arange(rows + 1))
    shift = np.uint64(64 - BITS)
    yield ((word * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), edge
    pair = np.flatnonzero(row[1:] == row[:-1])
    yield (((word[pair] * np.uint64(0xC2B2AE3D27D4EB4F) + word[pair + 1]) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64), np.searchsorted(row[pair], np.arange(rows + 1))
    points, at = code_points(raw, offsets)
    inner = np.zeros(len(raw) + 1, np.int8)
    inner[start[same]] += 1
    inner[end[same]] -= 1
    points = np.where(np.cumsum(inner[:-1])[(raw & 0xC0) != 0x80] > 0, REPEAT_SIGN, points)
    for n in LENGTHS:
        hashes = grams(points, n, BITS)
        inside = np.ones(len(hashes), bool)
        for back in range(1, n):
            cut = at[1:-1] - back
            inside[cut[(cut >= 0) & (cut < len(hashes))]] = False
        yield hashes[inside].astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - n + 1, 0))]).astype(np.int64)


class Model:
    """One weight for each hashed n-gram, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def rows(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for hashes, edge in features(raw, offsets):
            total += row_sums(self.weights[hashes], edge)
            count += np.diff(edge)
        value = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct n-grams and their shares."""
    out = []
    for _, offsets, raw in text_slices(pa.array(texts, pa.large_string()), SLICE):
        kinds = list(features(raw, offsets))
        for r in range(len(offsets) - 1):
            key, n = np.unique(np.concatenate([h[e[r] : e[r + 1]] for h, e in kinds]), return_counts=True)
            out.append((key, n / max(n.sum(), 1)))
    return out


def train(examples: list[tuple[str, int]], share: float | None = None, seed: int = 5) -> Model:
    """The model of texts with label 0 or 1; share is that of label 1 among all rows, where the sample does not show it."""
    ones = sum(y for _, y in examples)
    share = (ones / len(examples) if examples else 0.5) if share is None else share
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if ones in (0, len(examples)):
        return Model(np.zeros(1 << BITS), prior)
    rng = np.random.default_rng(seed)
    bags, y = _bags([t for t, _ in examples]), np.array([y for _, y in examples])
    vectors, out, bias = rng.uniform(-1, 1, (1 << BITS, SIZE)) / SIZE, np.zeros((SIZE, 2)), np.zeros(2)
    weight = np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones)))
    seen, out_seen = np.full(1 << BITS, 1e-9), np.full((SIZE, 2), 1e-9)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for a in range(0, len(order), BATCH):
            some = [i for i in order[a : a + BATCH] if len(bags[i][0])]
            if not some:
                continue
            key, part = np.concatenate([bags[i][0] for i in some]), np.concatenate([bags[i][1] for i in some])
            edge = np.cumsum([0, *(len(bags[i][0]) for i in some)])
            mean = np.add.reduceat(vectors[key] * part[:, None], edge[:-1])
            logit = mean @ out + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= weight[some][:, None]
            down, step = p @ out.T / len(some), mean.T @ p / len(some)
            out_seen += step**2
            out -= rate * step / np.sqrt(out_seen)
            bias -= rate * p.sum(axis=0) / len(some)
            # steps are scaled by those that came before, so that rare n-grams learn as fast as frequent ones
            rows, which = np.unique(key, return_inverse=True)
            pull = np.repeat(down, np.diff(edge), axis=0) * part[:, None]
            steps = np.stack([np.bincount(which, pull[:, d], len(rows)) for d in range(SIZE)], axis=1)
            seen[rows] += (steps**2).mean(axis=1)
            vectors[rows] -= rate * steps / np.sqrt(seen[rows])[:, None]
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]) + prior)


def quality_model(
    docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, label: str = "quality", id: str = "doc_id", text: str = "text",
    most: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS,
) -> Model:
    """Learned from a bounded sample of the labelled rows whose checksum modulo `parts` is not `held_out`."""
    allowed = remainder(id, parts) != held_out
    share = labels.where(allowed & F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(sample_by_label(docs.where(allowed).select(id, text), labels.where(allowed).select(id, label), label, [0, 1], most, chars, id, text), share)


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1.

    A null, empty or one-letter text has no n-grams and gets the share of label 1 as it was learned; equal texts have
    equal scores.  docs must not have a column of that name.
    """
    where, names = docs.columns.index(text), docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for first, offsets, raw in text_slices(batch.column(where), SLICE):
                score = known.rows(raw, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(score)) for c in batch.columns), pa.array(score)], names=[*names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, score double")
