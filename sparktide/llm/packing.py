"""Packing: token sequences of all documents, concatenated and cut into windows of fixed size.

Two passes.  The first tokenizes: every task keeps a running total, so a document knows where it starts within its
partition, and the table of ids goes to the shared folder.  The second turns the totals of the partitions into global
offsets by a prefix sum, and cuts each document where a window ends; the rows are the boundary records.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktide.llm.shared import give_back, stored, text_slices
from sparktide.llm.words import Family, mix

#: Pieces whose ids a worker remembers before it starts anew.
CACHED_PIECES = 300_000
#: Bytes of text that are split at a time.
SLICE = 1 << 19

#: Partitions of the first pass up to which their offsets are broadcast; beyond, they are joined by a shuffle.
MOST_PARTS = 1_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    """Space, letter, number or other, by code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE] = SPACE
    return out


def piece_starts(points: np.ndarray, classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the pieces start into which byte-level BPE splits a text before merging.

    points: code points of all rows; rows: the place where each row starts, with the end of the last.  A piece is a run
    of letters, of numbers or of other signs with one blank before it, a run of white space short of that blank, or one
    of the endings 's 't 'm 'd 're 've 'll.
    """
    n = len(points)
    kind = classes[points]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last sign of white space before something else: a blank joins what follows, another sign stands alone
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # an apostrophe alone, without a blank before it, and letters after it
    mark = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kind[1:] == LETTER) & ~edge[1:n])
    if len(mark):
        one = points[mark + 1]
        two = np.where((mark + 2 < n) & ~edge[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | long] + 1] = False
        after = mark[short | long] + np.where(short, 2, 3)[short | long]
        start[after[after < n]] = True
    return np.flatnonzero(start)


def _alphabet() -> dict[int, int]:
    """The printable sign that stands for each byte in the vocabulary: printable Latin-1 itself, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(own))}


class Ids:
    """Ids of texts, by the model of a byte-level BPE tokenizer file.

    BPE never merges across the pieces of its first split, so each piece is encoded once and remembered by its hash.
    A text that holds a special token is encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes, self.alphabet, self.hashes = _classes(), _alphabet(), Family(9)
        self.values = mix(np.arange(sys.maxunicode + 1, dtype=np.uint64))
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.at, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _numbers(self, signs: str, start: np.ndarray, end: np.ndarray, keys: list[int]) -> np.ndarray:
        """The number of each piece signs[start:end] among those remembered; new ones are encoded."""
        if len(self.number) + len(keys) > CACHED_PIECES:
            self.forget()
        known, encode = self.number, self.tokenizer.model.tokenize
        new = [i for i, k in enumerate(keys) if k not in known]
        made = [[t.id for t in encode(signs[a:b])] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        n = len(known)
        known.update(zip([keys[i] for i in new], range(n, n + len(new)), strict=True))
        flat = np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum()))
        while n + len(new) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.at[n : n + len(new)], self.size[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids per row) of UTF-8 rows without special tokens."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        text = raw.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        start = piece_starts(points, self.classes, lead[offsets])
        end = np.append(start[1:], len(points))
        key, first, which = np.unique(self.hashes.ranges(self.values[points], start, end), return_index=True, return_inverse=True)
        byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        number = self._numbers(raw.tobytes().decode("latin-1").translate(self.alphabet), byte[start[first]], byte[end[first]], key.tolist())[which]
        size = self.size[number]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.flat[np.repeat(self.at[number] - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, lead[offsets])])

    def rows(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ids per row) for runs of rows."""
        for first, offsets, raw in text_slices(texts, SLICE):
            whole = raw.tobytes()
            if any(s.encode() in whole for s in self.special):
                made = [self.tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets, offsets[1:], strict=False)]
                yield first, np.array([i for x in made for i in x], np.uint32), np.array([len(x) for x in made], np.int64)
            elif len(offsets) > 2 or len(raw) <= 2 * SLICE:
                yield first, *self.slice(raw, offsets)
            else:
                parts = [self.slice(raw[a:b], np.array([0, b - a]))[0] for a, b in _parts(whole)]
                yield first, np.concatenate(parts), np.array([sum(map(len, parts))], np.int64)


def _parts(text: bytes) -> Iterator[tuple[int, int]]:
    """Parts of a very long text, cut at blanks between two small letters: a piece always starts there."""
    cut, first = re.compile(rb"(?<=[a-z]) (?=[a-z])"), 0
    while len(text) - first > SLICE and (found := cut.search(text, first + SLICE)):
        yield first, found.start()
        first = found.start()
    yield first, len(text)


_ids: dict[str, Ids] = {}


def _encoder(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def tokenize(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Pass one: (doc_id, ids binary, n_tokens, part, part_start) for every row.

    ids are unsigned little-endian integers of 16 bits where all ids of the vocabulary fit, else of 32; a null text is
    empty and still gets the end id.  part and part_start say which partition held the row and how many ids stood
    before it there; they hold only for a written result.
    """
    from tokenizers import Tokenizer

    wide = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, total = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, ids, size in encode.rows(batch.column(1)):
                ends = np.cumsum(size)
                flat = np.insert(ids, ends, end_id).astype(wide)
                size = size + 1
                where = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                binary = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(where * flat.itemsize), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(size)), binary.cast(pa.binary()), pa.array(size), pa.array(np.full(len(size), part, np.int64)), pa.array(total + where[:-1])],
                    names=["doc_id", "ids", "n_tokens", "part", "part_start"],
                )
                total += int(where[-1])
        _ids.clear()
        del encode
        give_back()

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, ids binary, n_tokens long, part long, part_start long"
    )


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", length: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every sequence is full except the last one, so padding is less than one sequence over the whole corpus.  Rows that
    repeat, also with their doc_id, are packed each on their own; a null doc_id stays null; an empty or null text is the
    end id alone; no rows give no pieces.  Other columns of docs are ignored.
    """
    table = stored(tokenize(docs, tokenizer, id, text, end_id), "tokens")
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per partition of the first pass
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    if totals.count() <= MOST_PARTS:
        bases = F.broadcast(bases)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            size = 0
            for doc, ids, n, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                values = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")
                first = 0
                while first < n:
                    sequence, offset = divmod(at + first, length)
                    take = min(length - offset, n - first)
                    raw = values[first : first + take].astype("<u4").tobytes()
                    for k, v in zip(rows, (doc, first, take, zlib.crc32(raw), n, sequence, offset, raw if keep_ids else None), strict=True):
                        rows[k].append(v)
                    first, size = first + take, size + len(raw) * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()], names=list(rows))

    pieces = table.join(bases, "part").select("doc_id", "ids", "n_tokens", (F.col("base") + F.col("part_start")).alias("at")).mapInArrow(cut, f"{PIECES}, ids binary")
    return pieces if keep_ids else pieces.drop("ids")
