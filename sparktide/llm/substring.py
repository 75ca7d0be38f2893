"""Substring dedup: repeated passages found through difference-cover anchors.

A position is an anchor if its number modulo the period is in a difference cover.  Whatever the places of two equal
windows in their documents, they share an anchor at the same distance from their start, less than a period from it;
its hash takes `window - period + 1` words, so it lies inside the window.  Only windows around anchors that occur in
several documents are compared as a whole.

Documents are dealt to batches of a bounded number of bytes.  A batch sends its distinct anchors, sorted and packed, to
the bucket each falls in, and a bucket answers which of them occur elsewhere; the windows take the same way, with the
smallest document id of the batch, and the answer is the smallest of all.  A passage that a third of all documents
share is one entry of each batch, so neither a bucket nor a batch has a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktide.llm.shared import power_of_two, text_bytes, text_slices
from sparktide.llm.words import Family, counts, spans

#: Bytes of text in one batch and, as the text that they come from, of the hashes in one bucket.
BATCH_BYTES = 4_000_000
BUCKET_BYTES = 24_000_000

#: The smallest difference cover of period 7: every number from 0 to 6 is a difference of two of them modulo 7.
PERIOD, COVER = 7, (0, 1, 3)

#: Ids that are null count as larger than all others.
NO_ID = np.iinfo(np.int64).max

_anchor, _window, _second = Family(21), Family(22), Family(23)

ASKED = "_batch long, _bucket int, keys binary, more binary, least binary, several binary"


class Batch:
    """The words of all rows of one batch as hashes, with the anchors and windows among them."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, window: int):
        self.ids = ids.cast(pa.int64()).fill_null(NO_ID).to_numpy()
        self.window, self.anchor_words = window, window - PERIOD + 1
        hashes, second, rows = [], [], []
        for first, offsets, raw in text_slices(texts):
            start, end, row = spans(raw, offsets)
            hashes.append(_window.words(raw, start, end))
            second.append(_second.words(raw, start, end))
            rows.append(row + first)
        self.words, self.second, self.row = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((hashes, np.uint64), (second, np.uint64), (rows, np.int64)))
        self.size, self.first = counts(self.row, len(self.ids))
        self.number = np.arange(len(self.row)) - self.first[self.row]  # of a word in its row
        left = self.size[self.row] - self.number
        self.anchors = np.flatnonzero(np.isin(self.number % PERIOD, COVER) & (left >= self.anchor_words) & (self.size[self.row] >= window))
        self.whole = left >= window

    def anchor_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_anchor.windows(self.words, self.anchors, self.anchor_words), return_inverse=True)

    def several(self, which: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Smallest document id of each of n keys, and whether another one has it too."""
        ids = self.ids[row]
        least, most = np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, which, ids)
        np.maximum.at(most, which, ids)
        return least, least < most

    def windows_at(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words and two hashes of all windows that hold one of these anchors whole."""
        near = np.zeros(len(self.row) + 1, bool)
        for back in range(PERIOD):
            at = anchors - back
            at = at[at >= 0]
            near[at[self.row[at] == self.row[at + back]]] = True
        first = np.flatnonzero(near[:-1] & self.whole)
        return first, _window.windows(self.words, first, self.window), _second.windows(self.second, first, self.window).astype(np.uint32)


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _asked(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["_batch", "_bucket", "keys", "more", "least", "several"]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket starts among sorted keys; a bucket is the first bits of a key."""
    bucket = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    return np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64))


def _read(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]


def repeated_words(
    docs: DataFrame, window: int = 13, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), total_bytes: int | None = None,
) -> DataFrame:
    """Per row: id, text, the columns of carry, n_words, n_removed, removed (runs of word numbers), kept_text.

    Words are runs of anything but ASCII white space, unchanged.  A word is removed if a window of `window` words over it
    also starts in a row with a smaller id; all windows are those of the input.  kept_text joins the other words by one
    blank.  Rows with the same id are one document to this rule; a null id counts as the largest; null, empty and short
    texts lose nothing; no rows give none.  Columns that are neither named nor carried are ignored.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window needs at least {PERIOD + 1} words")
    size = text_bytes(docs, text) if total_bytes is None else total_bytes
    n_batches, bits = max(1, -(-size // BATCH_BYTES)), power_of_two(size / BUCKET_BYTES).bit_length() - 1
    names = list(dict.fromkeys([id, text, *carry]))
    key = F.pmod(F.xxhash64(F.col(id), F.when(F.col(id).isNull(), F.xxhash64(text))), F.lit(n_batches))
    rows = docs.select(F.lit(0).cast("long").alias("_batch"), *names).withColumn("_batch", key)
    kept = T.StructType([rows.schema[n] for n in names])
    full = T.StructType([*kept.fields, *T.StructType.fromDDL("n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept_text string").fields])

    def batch_of(table: pa.Table) -> Batch:
        return Batch(table.column(id), table.column(text), window)

    def ask_anchors(table: pa.Table) -> pa.Table:
        b = batch_of(table)
        keys, which = b.anchor_keys()
        several = b.several(which, b.row[b.anchors], len(keys))[1]
        edge = _edges(keys, bits)
        who = table.column("_batch")[0].as_py()
        return _asked([(who, k, _binary(keys[s:e]), None, None, _binary(np.packbits(several[s:e]))) for k, (s, e) in enumerate(zip(edge, edge[1:], strict=False)) if e > s])

    def answer_anchors(table: pa.Table) -> pa.Table:
        """For each asker the bits of its anchors that occur in two documents at least."""
        keys = _read(table, "keys", np.uint64)
        own = [np.unpackbits(x, count=len(k)).astype(bool) for x, k in zip(_read(table, "several", np.uint8), keys, strict=True)]
        every, times = np.unique(np.concatenate(keys), return_counts=True)
        shared = [np.packbits(o | (times[np.searchsorted(every, k)] > 1)) for k, o in zip(keys, own, strict=True)]
        who, bucket = table.column("_batch").to_pylist(), table.column("_bucket").to_pylist()
        return _asked([(w, c, None, None, None, _binary(s)) for w, c, s in zip(who, bucket, shared, strict=True)])

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _asked([])
        b = batch_of(table)
        keys, which = b.anchor_keys()
        shared, edge = np.zeros(len(keys), bool), _edges(keys, bits)
        for bucket, flags in zip(answers.column("_bucket").to_pylist(), _read(answers, "several", np.uint8), strict=True):
            s, e = edge[bucket], edge[bucket + 1]
            shared[s:e] = np.unpackbits(flags, count=e - s)
        first, one, two = b.windows_at(b.anchors[shared[which]])
        order = np.lexsort((two, one))
        one, two, first = one[order], two[order], first[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        at = np.flatnonzero(new)
        least, several = b.several(np.cumsum(new) - 1, b.row[first], len(at))
        keys, more = one[at], two[at]
        edge = _edges(keys, bits)
        who = table.column("_batch")[0].as_py()
        return _asked([
            (who, k, _binary(keys[s:e]), _binary(more[s:e]), _binary(least[s:e]), _binary(np.packbits(several[s:e])))
            for k, (s, e) in enumerate(zip(edge, edge[1:], strict=False)) if e > s
        ])

    def answer_windows(table: pa.Table) -> pa.Table:
        """For each asker those of its windows that a smaller document has, seen from one of its own documents."""
        keys, more, least = (_read(table, c, k) for c, k in (("keys", np.uint64), ("more", np.uint32), ("least", np.int64)))
        own = [np.unpackbits(x, count=len(k)).astype(bool) for x, k in zip(_read(table, "several", np.uint8), keys, strict=True)]
        sizes = np.cumsum([0, *map(len, keys)])
        one, two, low = np.concatenate(keys), np.concatenate(more), np.concatenate(least)
        order = np.lexsort((low, two, one))
        new = np.ones(len(one), bool)
        a, c = one[order], two[order]
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        smallest = np.empty(len(one), np.int64)
        smallest[order] = low[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        said = (smallest < low) | np.concatenate(own)
        out = []
        for i, (who, bucket) in enumerate(zip(table.column("_batch").to_pylist(), table.column("_bucket").to_pylist(), strict=True)):
            yes = said[sizes[i] : sizes[i + 1]]
            if yes.any():
                out.append((who, bucket, _binary(keys[i][yes]), _binary(more[i][yes]), _binary(smallest[sizes[i] : sizes[i + 1]][yes]), None))
        return _asked(out)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return kept_table(table, [], [], [], [])
        b = batch_of(table)
        gone = np.zeros(len(b.row) + 1, np.int64)
        if answers.num_rows:
            keys, more, least = (np.concatenate(_read(answers, c, k)) for c, k in (("keys", np.uint64), ("more", np.uint32), ("least", np.int64)))
            order = np.lexsort((more, keys))
            keys, more, least = keys[order], more[order], least[order]
            first = np.flatnonzero(b.whole)
            one = _window.windows(b.words, first, window)
            at = np.searchsorted(keys, one)
            maybe = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == one)
            first, at = first[maybe], at[maybe]
            two = _second.windows(b.second, first, window).astype(np.uint32)
            for _ in range(len(keys)):  # past entries of the same first hash
                later = (more[at] != two) & (at + 1 < len(keys)) & (keys[np.minimum(at + 1, len(keys) - 1)] == keys[at])
                if not later.any():
                    break
                at = at + later
            first = first[(more[at] == two) & (least[at] < b.ids[b.row[first]])]
            np.add.at(gone, first, 1)
            np.add.at(gone, first + window, -1)
        covered = np.cumsum(gone[:-1]) > 0
        removed = np.bincount(b.row[covered], minlength=len(b.ids))
        runs, texts = [], []
        for r, t in enumerate(table.column(text).to_pylist()):
            mask = covered[b.first[r] : b.first[r] + b.size[r]]
            words = (t or "").encode("utf-8").split()
            texts.append(b" ".join(words if not removed[r] else [w for w, m in zip(words, mask, strict=True) if not m]).decode("utf-8"))
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))) if removed[r] else np.zeros(0, np.int64)
            runs.append([{"first": int(s), "last": int(e) - 1} for s, e in zip(edge[::2], edge[1::2], strict=True)])
        return kept_table(table, b.size.tolist(), removed.tolist(), runs, texts)

    def kept_table(table: pa.Table, size: list, removed: list, runs: list, texts: list) -> pa.Table:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table(
            [*(table.column(n) for n in names), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())],
            names=[*names, "n_words", "n_removed", "removed", "kept_text"],
        )

    anchors = rows.groupBy("_batch").applyInArrow(ask_anchors, ASKED).groupBy("_bucket").applyInArrow(answer_anchors, ASKED)
    windows = rows.groupBy("_batch").cogroup(anchors.groupBy("_batch")).applyInArrow(ask_windows, ASKED)
    answers = windows.groupBy("_bucket").applyInArrow(answer_windows, ASKED)
    return rows.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(remove, full)
