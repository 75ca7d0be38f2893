"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.llm.labelled import remainder, sample_by_label
from sparktide.llm.points import code_points, grams, letters, row_sums
from sparktide.llm.shared import text_slices

#: Texts of each language that are learned from, and characters that such a text has at most.
TRAIN_TEXTS, TRAIN_CHARS = 1000, 12_000
#: Bits of an n-gram's hash, the lengths of n-grams, what is added to each count.
BITS, LENGTHS, SMOOTHING = 15, (1, 2, 3), 0.5
SLICE = 1 << 19

#: The answer for texts without letters, or where no language was learned.
UNKNOWN = "und"


class Grams:
    """Hashed n-grams of the letters of a slice; whatever is no letter counts as a blank, and runs of blanks not at all."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        points, self.edge = code_points(raw, offsets)
        letter = letters()[points]
        blank = letter == 32
        keep = np.ones(len(letter), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        at = np.zeros(len(letter) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        self.letter, self.edge = letter[keep], at[self.edge]
        self.has = row_sums((self.letter != 32).astype(np.float64), self.edge) > 0

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, and the edges of the rows among them; n-grams that cross into the next row are left out."""
        hashes, rows = grams(self.letter, n, BITS), len(self.edge) - 1
        size = np.maximum(np.diff(self.edge) - n + 1, 0)
        if n > 1 and rows > 1:
            inside = np.ones(len(hashes), bool)
            for back in range(1, n):
                cut = self.edge[1:-1] - back
                inside[cut[(cut >= 0) & (cut < len(hashes))]] = False
            hashes = hashes[inside]
        return hashes, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


class Model:
    """Languages and the matrix of log probabilities, one row each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(languages) else counts

    def rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        found = Grams(raw, offsets)
        if not self.languages:
            return [UNKNOWN] * len(found.has), np.zeros(len(found.has))
        total = np.zeros((len(self.languages), len(found.has)))
        for n in LENGTHS:
            hashes, edge = found.of(n)
            for i, logs in enumerate(self.logs):
                total[i] += row_sums(logs[hashes], edge)
        best = total.argmax(axis=0)
        share = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, found.has, strict=True)], np.where(found.has, share, 0.0)


def train(examples: list[tuple[str, str]]) -> Model:
    languages = sorted({y for _, y in examples})
    counts = np.zeros((len(languages), 1 << BITS))
    for i, language in enumerate(languages):
        for _, offsets, raw in text_slices(pa.array([t for t, y in examples if y == language], pa.large_string()), SLICE):
            found = Grams(raw, offsets)
            for n in LENGTHS:
                counts[i] += np.bincount(found.of(n)[0], minlength=1 << BITS)
    return Model(languages, counts)


def language_model(
    docs: DataFrame, parts: int = 4, held_out: int = 2, lang: str = "lang", id: str = "doc_id", text: str = "text", most: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS,
) -> Model:
    """Learned from a bounded sample of the texts of each language whose checksum modulo `parts` is not `held_out`."""
    own = docs.where((remainder(id, parts) != held_out) & F.col(lang).isNotNull()).select(id, text, lang)
    languages = sorted(r[0] for r in own.where(F.col(text).isNotNull()).select(lang).distinct().collect())
    return train(sample_by_label(own.select(id, text), own.select(id, lang), lang, languages, most, chars, id, text))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the share of that language among the learned ones.

    A null text or one without a letter is `und` with score 0, as are all texts if no language was learned; ties go to
    the first language in alphabetical order.  docs must not have columns of these two names.
    """
    where, names = docs.columns.index(text), docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for first, offsets, raw in text_slices(batch.column(where), SLICE):
                language, share = known.rows(raw, offsets)
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(share)) for c in batch.columns), pa.array(language, pa.string()), pa.array(share)], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")
