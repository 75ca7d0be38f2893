"""Toxicity: a support vector machine with a gap-weighted subsequence kernel, approximated on Nystroem landmarks.

The kernel of two words counts the runs of four letters they share in order, with gaps: a gap of g letters costs a factor
DECAY ** g, and more than MOST_GAP gaps count for nothing.  So an insult with a letter put in or left out stays near the
plain one.  As the word norm grows with a letter put in, a word counts also as it is without any one of its inner letters,
unless clean texts have it.  Signs between the letters of a word are left out before, and words of one letter that follow each other are
one word, so that `i.d-i o t` is read as a whole.

Labels are those of documents, the kernel works on single words.  A word of two or three letters has an edge sign before and
after, so that it has subsequences too; one of a single letter has none, and a phrase of words that are harmless one by one
is not found.  Training takes the strongest words of each toxic document, those of clean ones nearest to toxic and a share
of the others, and repeats; the bounds are parameters.  A document is as toxic as its strongest word.  Landmarks are words of both; the machine is linear in the mapped
kernel values, so it folds into one weight for each subsequence that a landmark has, and scoring looks these up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.llm.labelled import remainder, sample_by_label
from sparktide.llm.shared import give_back, text_slices
from sparktide.llm.words import LOWER, SPACES

#: Texts of each label that are learned from, and characters that such a text has at most.
TRAIN_TEXTS, TRAIN_CHARS = 1200, 12_000
LANDMARKS, ROUNDS = 160, 3
#: Strongest words taken of a toxic and of a clean text, one in so many of all words of clean texts, and words of each kind at most.
TOXIC_WORDS, CLEAN_WORDS, EVERY, MOST_TOXIC, MOST_CLEAN = 2, 3, 37, 6000, 12_000
LETTERS, DECAY, MOST_GAP = 4, 0.75, 2
SLICE = 1 << 19
#: Probability from which a word counts without one of its letters.
LIKELY = 0.5

#: Places of the letters of a subsequence from its first one, and the weight of each pattern.
PATTERNS = [(0, *p) for p in combinations(range(1, LETTERS + MOST_GAP), LETTERS - 1)]
WEIGHTS = [DECAY ** (p[-1] - LETTERS + 1) for p in PATTERNS]

#: Stands before and after a short word.
EDGE = 1


def _padded(word: bytes) -> bytes:
    return b"%c%b%c" % (EDGE, word, EDGE) if 1 < len(word) < LETTERS else word


_KEPT = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
#: Signs that stand for a letter when they are between two letters.
_STANDS = np.arange(256, dtype=np.uint8)
for _sign, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
    _STANDS[ord(_sign)] = ord(_letter)


class Letters:
    """The letters of a slice of texts, with the word of each and the row of each word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw = LOWER[raw]
        letter, n = _KEPT[raw], len(raw)
        if n > 2:
            between = np.zeros(n, bool)
            between[1:-1] = letter[:-2] & letter[2:] & ~letter[1:-1]
            raw = np.where(between, _STANDS[raw], raw)
            letter = _KEPT[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        parts = np.cumsum(SPACES[raw] | edge[:-1])  # a part is what stands between white space
        at = np.flatnonzero(letter)
        self.letters = raw[at]
        part, first, size = np.unique(parts[at], return_index=True, return_counts=True)
        row = np.searchsorted(offsets, at[first], "right") - 1
        single = (size == 1) & (self.letters[first] < 128) if len(part) else np.zeros(0, bool)
        joins = np.zeros(len(part), bool)
        joins[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1]) & (np.diff(part) == 1)
        number = np.cumsum(~joins) - 1
        self.word = np.repeat(number, size)
        self.row = row[~joins]
        self.size = np.bincount(self.word, minlength=len(self.row))
        self.first = np.cumsum(self.size) - self.size
        short = (self.size > 1) & (self.size < LETTERS)
        if short.any():
            size = self.size + 2 * short
            first = np.cumsum(size) - size
            padded = np.full(int(size.sum()), EDGE, np.uint8)
            padded[np.arange(len(self.letters)) + (first - self.first + short)[self.word]] = self.letters
            self.letters, self.word, self.size, self.first = padded, np.repeat(np.arange(len(size)), size), size, first

    def keys(self, pattern: tuple[int, ...]) -> np.ndarray:
        """The four letters of the pattern from each place on, as one number; across words as well."""
        n = len(self.letters) - pattern[-1]
        if n <= 0:
            return np.zeros(0, np.uint32)
        key = self.letters[:n].astype(np.uint32)
        for i, p in enumerate(pattern[1:], 1):
            key |= self.letters[p : p + n].astype(np.uint32) << np.uint32(8 * i)
        return key

    def inside(self, at: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
        return at[self.word[at] == self.word[at + pattern[-1]]]

    def text(self, word: int) -> bytes:
        return self.letters[self.first[word] : self.first[word] + self.size[word]].tobytes().strip(bytes([EDGE]))


def lengths(size: np.ndarray) -> np.ndarray:
    """The norm that a word of this many letters has if its subsequences are all different."""
    total = sum(w * w * np.maximum(size - p[-1], 0) for p, w in zip(PATTERNS, WEIGHTS, strict=True))
    return np.sqrt(np.maximum(total, 1.0))


class Lookup:
    """Finds which subsequences of a text are among given ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769)) >> np.uint32(12)

    def hits(self, text: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, number of the key, weight) for every occurrence."""
        word, number, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for pattern, at, found in self.places(text):
            word.append(text.word[at])
            number.append(found)
            weight.append(np.full(len(at), WEIGHTS[pattern]))
        return np.concatenate(word), np.concatenate(number), np.concatenate(weight)

    def places(self, text: Letters) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the pattern, places of its first letter, numbers of the keys) for each pattern."""
        for n, pattern in enumerate(PATTERNS):
            keys = text.keys(pattern)
            at = text.inside(np.flatnonzero(self.seen[self._slot(keys)]), pattern)
            if not len(at) or not len(self.keys):
                continue
            found = np.searchsorted(self.keys, keys[at])
            same = self.keys[np.minimum(found, len(self.keys) - 1)] == keys[at]
            yield n, at[same], found[same]


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Model:
    """Weights of subsequences, and the curve from the strongest word to a probability."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.lookup, self.weights, self.bias, self.slope, self.shift = Lookup(keys), weights, bias, slope, shift
        self.harmless: frozenset[bytes] = frozenset()

    def words(self, text: Letters) -> np.ndarray:
        word, number, weight = self.lookup.hits(text)
        return np.bincount(word, weight * self.weights[number], len(text.row)) / lengths(text.size) + self.bias

    def both(self, text: Letters) -> tuple[np.ndarray, np.ndarray]:
        """Value of each word as it is, and the highest it has without one of its inner letters.

        Without a letter, the subsequences that use it are gone, and those that pass over it have a gap less.
        """
        n, total, at_letter = len(text.letters), np.zeros(len(text.row)), []
        for k, at, number in self.lookup.places(text):
            worth = WEIGHTS[k] * self.weights[number]
            total += np.bincount(text.word[at], worth, len(text.row))
            at_letter += [(at + i, -worth if i in PATTERNS[k] else worth * (1 / DECAY - 1)) for i in range(PATTERNS[k][-1] + 1)]
        value = total / lengths(text.size) + self.bias
        less = np.full(len(text.row), -np.inf)
        if at_letter:
            change = np.bincount(np.concatenate([a for a, _ in at_letter]), np.concatenate([v for _, v in at_letter]), n)
            own = np.flatnonzero((text.size > LETTERS) & (total > 0) & (text.letters[text.first] != EDGE))
            place = np.repeat(text.first[own] + 1, text.size[own] - 2) + _counting(text.size[own] - 2)
            most = np.maximum.reduceat(change[place], np.cumsum(text.size[own] - 2) - (text.size[own] - 2)) if len(own) else np.zeros(0)
            less[own] = (total[own] + most) / lengths(text.size[own] - 1) + self.bias
        return value, less

    def rows(self, text: Letters, rows: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Value of each row, and its strongest word (-1 if it has none); of the words as they may be read, or of given values."""
        value, words = np.full(rows, self.bias), self.hidden(text)[0] if words is None else words
        best = np.full(rows, -1)
        if len(words):
            order = np.lexsort((-np.arange(len(words)), words, text.row))
            last = np.flatnonzero(np.append(np.diff(text.row[order]) != 0, True))
            best[text.row[order[last]]] = order[last]
            value[text.row[order[last]]] = np.maximum(words[order[last]], self.bias)
        return value, best

    def hidden(self, text: Letters) -> tuple[np.ndarray, np.ndarray]:
        """Value of each word, and the words that are likely toxic only without one letter."""
        value, less = self.both(text)
        likely = np.flatnonzero((less > value) & (self.probability(less) >= LIKELY))
        likely = likely[[text.text(w) not in self.harmless for w in likely]] if len(likely) else likely
        value[likely] = less[likely]
        return value, likely

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


def _constant(score: float) -> Model:
    return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0, 0.0, float(np.log(max(score, 1e-9) / max(1 - score, 1e-9))))


def _of(texts: list[str]) -> list[tuple[Letters, int]]:
    return [(Letters(raw, offsets), len(offsets) - 1) for _, offsets, raw in text_slices(pa.array(texts, pa.large_string()), SLICE)]


def _first_guess(toxic: list, clean: list) -> tuple[np.ndarray, np.ndarray]:
    """Runs of four letters, and how far the share of toxic texts with them exceeds that of clean ones, in deviations."""
    seen = []
    for slices in (toxic, clean):
        found, base = [np.zeros(0, np.uint64)], 0
        for text, rows in slices:
            at = text.inside(np.arange(max(0, len(text.letters) - 3)), PATTERNS[0])
            found.append(np.unique((np.uint64(base) + text.row[text.word[at]].astype(np.uint64)) << np.uint64(32) | text.keys(PATTERNS[0])[at]))
            base += rows
        seen.append((np.unique((np.concatenate(found) & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True), base))
    ((keys, n), toxic_rows), ((clean_keys, clean_n), clean_rows) = seen
    other = np.zeros(len(keys))
    at = np.minimum(np.searchsorted(clean_keys, keys), max(len(clean_keys) - 1, 0))
    if len(clean_keys):
        other = np.where(clean_keys[at] == keys, clean_n[at], 0)
    share = (n + other) / (toxic_rows + clean_rows)
    z = (n / toxic_rows - other / clean_rows) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / toxic_rows + 1 / clean_rows))
    return keys, np.where(z > 2, z, 0)


def _strongest(slices: list, words_of, most: int) -> list[list[tuple[float, bytes]]]:
    """For each row its up to `most` strongest words with their values."""
    out = []
    for text, rows in slices:
        value = words_of(text)
        order = np.lexsort((-value, text.row))
        edge = np.searchsorted(text.row[order], np.arange(rows + 1))
        out += [[(float(value[w]), text.text(w)) for w in order[a : min(b, a + most)]] for a, b in zip(edge, edge[1:], strict=False)]
    return out


def _features(words: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, key, value) of the normed subsequence vectors of words."""
    words = [_padded(w) for w in words]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    text = Letters.__new__(Letters)
    size = np.array([len(w) for w in words])
    text.letters, text.word, text.size = raw[raw != 32], np.repeat(np.arange(len(words)), size), size
    word, number, weight = Lookup(keys).hits(text)
    return word, number, weight / lengths(size)[word]


def _all_keys(words: list[bytes]) -> np.ndarray:
    keys = {bytes(w[i + p] for p in pattern) for w in map(_padded, words) for pattern in PATTERNS for i in range(len(w) - pattern[-1])}
    return np.unique(np.frombuffer(b"".join(sorted(keys)), "<u4")) if keys else np.zeros(0, np.uint32)


def _kernel(words: list[bytes], keys: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of words and landmarks (their normed vectors over keys)."""
    word, number, value = _features(words, keys)
    order = np.argsort(word, kind="stable")
    word, number, value = word[order], number[order], value[order]
    out = np.zeros((len(words), landmarks.shape[0]))
    for a in range(0, len(words), 2000):
        s, e = np.searchsorted(word, [a, a + 2000])
        dense = np.zeros((min(2000, len(words) - a), landmarks.shape[1]), np.float32)
        np.add.at(dense, (word[s:e] - a, number[s:e]), value[s:e])
        out[a : a + 2000] = dense @ landmarks.T
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        active = y * (x @ w) < 1
        a = x[active] * (weight[active] * cost / weight.sum() * 100)[:, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def train(
    examples: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS, toxic_words: int = TOXIC_WORDS, clean_words: int = CLEAN_WORDS,
    every: int = EVERY, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN,
) -> Model:
    """The model of labelled texts; the share of label 1 for every text where one label is missing.

    Of a toxic text the `toxic_words` strongest words are learned from, of a clean one the `clean_words` strongest, and one in
    `every` of all words of clean texts; in all the most frequent `most_toxic` and `most_clean` of these.
    """
    texts = {y: [t for t, label in examples if label == y] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        return _constant(len(texts[1]) / max(len(examples), 1))
    toxic, clean = _of(texts[1]), _of(texts[0])
    keys, z = _first_guess(toxic, clean)
    guess = Lookup(keys[z > 0])
    good = z[z > 0]

    def guessed(text: Letters) -> np.ndarray:
        value = np.zeros(len(text.row))
        word, number, weight = guess.hits(text)
        plain = weight == 1
        np.maximum.at(value, word[plain], good[number[plain]])
        return value

    value_of, model = guessed, None
    for _ in range(rounds):
        bad = _strongest(toxic, value_of, toxic_words)
        witness: dict[bytes, float] = {}
        for own in bad:
            for v, w in own:
                if own[0][0] > 0 and v >= 0.5 * own[0][0] and len(w) > 1:
                    witness[w] = witness.get(w, 0.0) + (v if model is None else 1.0)
        plain: dict[bytes, int] = {}
        for own in _strongest(clean, value_of, clean_words):  # the words of clean texts nearest to toxic ones
            for _v, w in own:
                if len(w) > 1:
                    plain[w] = plain.get(w, 0) + 1
        for text, _rows in clean:
            for w in range(0, len(text.row), every):
                word = text.text(w)
                if len(word) > 1:
                    plain.setdefault(word, 0)
        for w in [w for w in witness if plain.get(w, 0) > 2]:
            del witness[w]
        if not witness or not plain:
            return model or _constant(len(texts[1]) / len(examples))
        positive = sorted(witness, key=lambda w: (-witness[w], w))
        negative = sorted((w for w in plain if w not in witness), key=lambda w: (-plain[w], w))[:most_clean]
        near = sorted(positive[: landmarks * 2 // 3] + negative[: landmarks // 3])
        keys = _all_keys(near)
        if not len(keys):
            return model or _constant(len(texts[1]) / len(examples))
        vectors = np.zeros((len(near), len(keys)), np.float32)
        word, number, value = _features(near, keys)
        np.add.at(vectors, (word, number), value)
        size, turn = np.linalg.eigh((vectors @ vectors.T).astype(np.float64))
        some = size > 1e-6 * size.max()
        root = turn[:, some] / np.sqrt(size[some])
        words = positive[:most_toxic] + negative
        y = np.where(np.arange(len(words)) < min(len(positive), most_toxic), 1.0, -1.0)
        count = np.array([np.sqrt(max(1.0, witness.get(w, 1.0))) for w in words])
        each = np.where(y > 0, count / count[y > 0].sum(), 1 / max((y < 0).sum(), 1))
        w = _svm(_kernel(words, keys, vectors) @ root, y, each)
        model = Model(keys, vectors.T.astype(np.float64) @ (root @ w[:-1]), float(w[-1]), 1.0, 0.0)
        value_of = model.words
    value = np.concatenate([model.rows(text, rows, model.words(text))[0] for text, rows in (*toxic, *clean)])
    y = np.repeat([1.0, 0.0], [len(texts[1]), len(texts[0])])
    # label 1 is rarer outside the sample; smoothed targets keep the curve finite
    target = np.where(y > 0, (len(texts[1]) + 1) / (len(texts[1]) + 2), 1 / (len(texts[0]) + 2))
    ab = np.zeros(2)
    x = np.stack([value, np.ones(len(value))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * ab)
        ab += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    model.slope, model.shift = float(ab[0]), float(ab[1])
    model.harmless = frozenset(text.text(w) for text, _rows in clean for w in model.hidden(text)[1])
    return model


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and evidence, the letters of the strongest word.

    A null, empty or wordless text has the score of a text without any known subsequence and no evidence; equal texts
    have equal scores.  docs must not have columns of these two names.
    """
    where, names = docs.columns.index(text), docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for first, offsets, raw in text_slices(batch.column(where), SLICE):
                rows = len(offsets) - 1
                letters = Letters(raw, offsets)
                value, best = known.rows(letters, rows)
                worst = [letters.text(b).decode("utf-8", "replace") if b >= 0 else None for b in best]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, rows) for c in batch.columns), pa.array(known.probability(value)), pa.array(worst, pa.string())], names=[*names, "score", "evidence"]
                )
        give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, score double, evidence string")


def toxicity_model(
    docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, label: str = "toxic", id: str = "doc_id", text: str = "text",
    most: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS, **bounds: int,
) -> Model:
    """The model learned from a bounded sample of the labelled rows whose checksum modulo `parts` is not `held_out`; bounds go to train."""
    own = docs.where(remainder(id, parts) != held_out).select(id, text)
    return train(sample_by_label(own, labels.select(id, label), label, [0, 1], most, chars, id, text), **bounds)
