"""Benchmark decontamination: one automaton over all windows of the test items scans every document once.

Text is normalised to lower-case words with one blank between them, and so are the items.  A window is a run of words of
an item; the automaton finds every place where one occurs between blanks.  Hits are word numbers, which map to offsets
of the original text through its own words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktide.llm.shared import give_back

#: Bytes of item text in one automaton.  More items are dealt to several, and the documents scanned once for each.
ITEM_BYTES = 8_000_000

#: A-Z to a-z; digits, a-z and all bytes of other alphabets stay; anything else is a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

FOUND = "n_words long, words array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def normal(text: str | None) -> str:
    """Words joined by one blank, with one before and after; a text without words is a blank."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else " "


def windows(text: str | None, size: int) -> list[str]:
    """Every run of `size` words, or the whole item if it has fewer, but not none."""
    words = normal(text).split(" ")[1:-1]
    return [f" {' '.join(words[i : i + size])} " for i in range(max(1, len(words) - size + 1))] if words else []


class Scanner:
    """The automaton with the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], size: int):
        import ahocorasick

        owners: dict[str, set[str]] = {}
        for item, text in items:
            for w in windows(text, size):
                owners.setdefault(w, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, who in owners.items():
            self.automaton.add_word(w, (len(w), w.count(" ") - 1, who))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def __call__(self, text: str) -> tuple[int, list[int], set[str]]:
        """Number of words of a normalised text, numbers of the words hit, items found."""
        n = text.count(" ") - 1 if len(text) > 1 else 0
        found = list(self.automaton.iter(text)) if self.any and n else []
        if not found:
            return n, [], set()
        blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 0x20)
        hit, items = np.zeros(n, bool), set()
        for end, (length, words, who) in found:
            first = int(np.searchsorted(blanks, end - length + 1))
            hit[first : first + words] = True
            items |= who
        return n, np.flatnonzero(hit).tolist(), items


def _places(text: str, words: list[int]) -> list[dict[str, int]]:
    """Runs of hit words as character offsets of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    each = [m.span() for m in WORD.finditer(raw)]
    out: list[list[int]] = []
    last = -2
    for w in words:
        if w == last + 1:
            out[-1][1] = each[w][1]
        else:
            out.append(list(each[w]))
        last = w
    edges = np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
    return [{"start": int(edges[a]) - 1, "end": int(edges[b - 1])} for a, b in out]


_scanners: dict[str, Scanner] = {}


def scan(docs: DataFrame, items: list[tuple[str, str | None]], size: int, text: str = "text") -> DataFrame:
    """docs with n_words, words (numbers of those hit), items, spans, found by one automaton.

    If docs went through another scan, what is found is added to that.
    """
    sent = docs.sparkSession.sparkContext.broadcast(items)
    again = docs.columns[-4:] == ["n_words", "words", "items", "spans"]
    own = len(docs.columns) - 4 * again
    where, key = docs.columns.index(text), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(sent.value, size)
        find = _scanners[key]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                texts = some.column(where).to_pylist()
                made = [find(normal(t)) for t in texts]
                if again:
                    before = zip(made, some.column(own + 1).to_pylist(), some.column(own + 2).to_pylist(), strict=True)
                    made = [(n, sorted({*hit, *words}), who.union(known)) for (n, hit, who), words, known in before]
                spans = [_places(t, m[1]) if m[1] else [] for t, m in zip(texts, made, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                more = [
                    pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int32())),
                    pa.array([sorted(m[2]) for m in made], pa.list_(pa.string())), pa.array(spans, kind),
                ]
                yield pa.RecordBatch.from_arrays([*some.columns[:own], *more], names=[*some.schema.names[:own], "n_words", "words", "items", "spans"])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:own], *T.StructType.fromDDL(FOUND).fields]))


def item_groups(benchmark: DataFrame, item: str, text: str, limit: int) -> list[list[tuple[str, str | None]]]:
    """Items in groups of at most `limit` bytes, or one item: the size of each group bounds what one automaton holds."""
    chars = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = -(-max(chars, 1) // limit)
    keyed = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    if n == 1:
        return [[(r.i, r.t) for r in keyed.collect()]]
    part = F.pmod(F.xxhash64("i"), F.lit(2 * n))
    return [[(r.i, r.t) for r in keyed.where(part == k).collect()] for k in range(2 * n)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, one_in: int = 20, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = (), item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Per row: id, text, the columns of carry, n_words, n_hit, items (sorted), spans, contaminated.

    A row is contaminated if any word is hit and at least one word in `one_in` is hit.  A null or wordless
    text has no words and is clean; an item without words, without text or without id never matches; no items leave all
    rows clean.  Repeated rows are judged each on its own.  Columns that are neither named nor carried are ignored.
    """
    rows = docs.select(*dict.fromkeys([id, text, *carry]))
    found = rows
    for group in item_groups(benchmark, item, item_text, item_bytes):
        found = scan(found, group, size, text)
    hits = F.size("words").cast("long")
    return found.select(
        *rows.columns, "n_words", hits.alias("n_hit"), "items", "spans",
        ((hits > 0) & (hits * one_in >= F.col("n_words"))).alias("contaminated"),
    )
