"""Byte dedup: every repeated string of a given length, found in suffix arrays of shards.

A window is `length` bytes of one document.  It belongs to the anchor that its content chooses, the ANCHOR bytes of least
hash inside it, so equal windows have equal anchors; the windows of one anchor that follow each other form a span.  Only
spans whose anchor occurs elsewhere go on.  All spans of an anchor meet in a shard; the shard is sorted by induction
(`suffix_array`), permuted common prefixes say which neighbours in the array agree in a whole window, and of each run of
equal windows all but the earliest are removed.

Documents are dealt to batches of a bounded number of bytes, and a batch sends equal spans once, so a passage that a
third of all documents share is one span of each batch.  An anchor with more than HOT_SPANS different spans (where a
common passage ends, the text after it differs) sends its windows one by one, dealt by their own hash, so that a shard
holds no unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktide.llm.shared import give_back, text_bytes, text_slices
from sparktide.llm.suffix_array import common_prefixes, suffix_array
from sparktide.llm.words import Family, mix

#: Bytes of an anchor; a window of 100 bytes has 81 places for it, so one byte in 41 starts one.
ANCHOR = 20

#: Bytes of text of one batch and, if all of it were repeated, of one shard's share; bytes sorted as one array.
BATCH_BYTES = 4_000_000
SHARD_BYTES = 2_000_000
ARRAY_BYTES = 2_000_000

#: Different spans of one anchor, counted by batch, beyond which its windows are dealt one by one.
HOT_SPANS = 40_000

#: Ids that are null count as larger than all others.
NO_ID = np.iinfo(np.int64).max

#: A count of spans shares a long with the number of its batch.
COUNT_BITS = 20

_bytes = Family(31)

ANCHORS = "anchor long, batch_spans long"
SPANS = "_batch long, key long, id long, tie long, at long, row int, text binary, others binary"
ANSWERS = "_batch long, windows int, places binary, mask binary"


def anchor_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position on that has so many."""
    total, done, left, hashed = np.zeros(0, np.uint64), 0, size, _bytes.table[raw]
    step, width = hashed, 1  # hashes of width bytes
    while left:
        if left & 1:
            n = len(raw) - (done + width) + 1
            total = step[:n] if not done else total[:n] * np.uint64(_bytes.bases[1] + 2 * width) + step[done : done + n]
            done += width
        left >>= 1
        if left:
            n = len(step) - width
            step, width = step[:n] * np.uint64(_bytes.bases[0] + 2 * width) + step[width:], 2 * width
    return mix(total)


def window_spans(raw: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first position and number of the valid windows of each span, in order of position."""
    hashes = anchor_hashes(raw, ANCHOR)
    width = length - ANCHOR + 1
    # the least of the upper hash halves, the leftmost of equal ones, is the least of these numbers
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    first = np.flatnonzero(valid)
    anchor = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    start = np.flatnonzero(new)
    return hashes[anchor[start]].view(np.int64), first[start], np.diff(start, append=len(first))


class Batch:
    """Documents of one batch in the order (id, tie), and their spans in the order of documents and positions."""

    def __init__(self, table: pa.Table, id: str, text: str, length: int):
        ids = table.column(id).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        ties = table.column("_tie").to_numpy()
        order = np.lexsort((ties, ids))
        self.table, self.ids, self.ties = table.take(pa.array(order)), ids[order], ties[order]
        self.length = length
        self.texts = self.table.column(text)
        found = [x for x in self._spans()]
        self.anchor, self.row, self.start, self.size = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(4))

    def _pieces(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First row, byte where the piece starts in it, offsets and bytes; a long row comes in overlapping pieces."""
        for first, offsets, raw in text_slices(self.texts):
            if len(offsets) > 2 or len(raw) <= 1 << 20:
                yield first, 0, offsets, raw
                continue
            for at in range(0, len(raw), 1 << 19):
                part = raw[at : at + (1 << 19) + self.length - 1]
                yield first, at, np.array([0, len(part)]), part

    def _spans(self) -> Iterator[tuple[np.ndarray, ...]]:
        for first, at, offsets, raw in self._pieces():
            if len(raw) < self.length:
                continue
            edge = np.zeros(len(raw) + 1, np.int64)
            long = np.diff(offsets) >= self.length
            np.add.at(edge, offsets[:-1][long], 1)
            np.add.at(edge, offsets[1:][long] - self.length + 1, -1)
            valid = np.cumsum(edge)[: len(raw) - self.length + 1] > 0
            anchor, start, size = window_spans(raw, valid, self.length)
            row = np.searchsorted(offsets, start, "right") - 1
            yield anchor, row + first, start - offsets[row] + at, size

    def contents(self, which: np.ndarray) -> Iterator[bytes]:
        """The bytes of spans, given in ascending order."""
        row, text = -1, b""
        for k in which.tolist():
            if self.row[k] != row:
                row = int(self.row[k])
                text = (self.texts[row].as_py() or "").encode()
            at = self.start[k]
            yield text[at : at + self.size[k] + self.length - 1]


def _anchor_rows(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors, and for each its number of different spans."""
    anchors, which, times = np.unique(batch.anchor, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[which] > 1)
    different = {(int(w), c) for w, c in zip(which[several], batch.contents(several), strict=True)}
    spans = np.where(times > 1, 0, 1)
    np.add.at(spans, [w for w, _ in different], 1)
    return anchors, spans


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def late_windows(table: pa.Table, length: int) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Spans with windows that are not the earliest of their content, or with more than one place: row, windows, packed truth values.

    Of equal spans only the earliest is sorted; all windows of the others are later.
    """
    which = table.column("text").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((*(table.column(c).to_numpy() for c in ("at", "tie", "id")), which))
    first = order[np.append(True, np.diff(which[order]) > 0)[: len(order)]]
    late, begin, windows = earliest(table.take(pa.array(first)), length)
    leads = np.zeros(len(which), bool)
    leads[first] = True
    sums = np.concatenate([[0], np.cumsum(late)])
    some = sums[begin + windows] > sums[begin]
    several = pa.compute.binary_length(table.column("others")).to_numpy() > 16
    rows = np.flatnonzero(~leads | some[which] | several)
    all_late = {n: np.packbits(np.ones(n, bool)).tobytes() for n in np.unique(windows).tolist()}
    sizes = windows[which[rows]].tolist()
    masks = [
        np.packbits(late[b : b + n]).tobytes() if lead else all_late[n]
        for b, n, lead in zip(begin[which[rows]].tolist(), sizes, leads[rows].tolist(), strict=True)
    ]
    return rows, sizes, masks


def earliest(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different spans the windows that are not the earliest of their content: truth values of all bytes, where each span begins, its windows."""
    texts = table.column("text").to_pylist()
    sizes = np.array([len(t) for t in texts])
    # bytes of UTF-8 stay below 255, so 0 is free for the ends
    text = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    array = suffix_array(text, length)
    span = np.repeat(np.arange(len(texts)), sizes + 1)
    room = (begin + sizes)[span] - np.arange(len(text))
    agree = common_prefixes(text, array, room)[array] >= length
    late = np.zeros(len(text), bool)
    run = np.cumsum(~agree)
    member = agree.copy()
    member[:-1] |= agree[1:]
    at, run = array[member], run[member]
    own = span[at]
    start = table.column("at").to_numpy()[own] + at - begin[own]
    tie, id = table.column("tie").to_numpy()[own], table.column("id").to_numpy()[own]
    order = np.lexsort((start, tie, id, run))
    again = np.zeros(len(at), bool)
    again[1:] = run[order[1:]] == run[order[:-1]]
    late[at[order[again]]] = True
    return late, begin, sizes - length + 1


def repeated_bytes(docs: DataFrame, length: int = 100, id: str = "doc_id", text: str = "text", total_bytes: int | None = None, hot_spans: int = HOT_SPANS) -> DataFrame:
    """Per row: id, n_bytes, n_removed, removed (runs of byte numbers), kept (the bytes left, joined).

    A byte of the UTF-8 text is removed if a string of `length` bytes over it also starts earlier: in a row with a smaller
    id, or before in the same row; overlapping ones count, strings are those of the input and never cross rows.  Rows with
    one id follow each other by a hash of their texts, and equal rows one after the other, so the first keeps its bytes; a
    null id counts as the largest.  Null, empty and short texts lose nothing; no rows give none.  Other columns are
    ignored, whatever their names.  kept may end inside a character.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"a string needs at least {2 * ANCHOR} bytes")
    size = text_bytes(docs, text) if total_bytes is None else total_bytes
    n_batches, n_shards = (max(1, -(-size // b)) for b in (BATCH_BYTES, SHARD_BYTES))
    tie = F.xxhash64(text)
    key = F.pmod(F.xxhash64(F.col(id), F.when(F.col(id).isNull(), tie)), F.lit(n_batches))
    rows = docs.select(key.alias("_batch"), F.col(id), F.col(text), tie.alias("_tie"))
    kinds = T.StructType([rows.schema[id], *T.StructType.fromDDL("n_bytes long, n_removed long, removed array<struct<first:long,last:long>>, kept binary").fields])

    def ask(table: pa.Table) -> pa.Table:
        batch = Batch(table, id, text, length)
        anchors, spans = _anchor_rows(batch)
        who = table.column("_batch")[0].as_py()
        give_back()
        return pa.table([pa.array(anchors, pa.int64()), pa.array((who << COUNT_BITS) | np.minimum(spans, (1 << COUNT_BITS) - 1), pa.int64())], names=["anchor", "batch_spans"])

    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows:
            batch = Batch(table, id, text, length)
            known, hot = shared.column("anchor").to_numpy(), shared.column("hot").to_numpy(zero_copy_only=False)
            anchors, which, times = np.unique(batch.anchor, return_inverse=True, return_counts=True)
            wanted = (times > 1) | np.isin(anchors, known)
            single = np.isin(anchors, known[hot])[which]
            groups: dict[tuple, list[int]] = {}
            places: list[tuple[int, int, int]] = []
            chosen = np.flatnonzero(wanted[which])
            for k, content in zip(chosen.tolist(), batch.contents(chosen), strict=True):
                row, start = int(batch.row[k]), int(batch.start[k])
                # windows of a hot anchor are spans of their own, dealt by their content
                parts = [(xxhash.xxh64_intdigest(w := content[i : i + length]) - (1 << 63), w, i) for i in range(int(batch.size[k]))] if single[k] else [(int(batch.anchor[k]), content, 0)]
                for name, part, skip in parts:
                    groups.setdefault((name, part), []).append(len(places))
                    places.append((row, start + skip, len(part) - length + 1))
            who = table.column("_batch")[0].as_py()
            for (name, part), own in groups.items():  # the first place is the earliest
                row, start, _ = places[own[0]]
                others = np.array([places[o][:2] for o in own], np.int64)
                out.append((who, name, int(batch.ids[row]), int(batch.ties[row]), start, row, part, _packed(others)))
        give_back()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(types)], names=["_batch", "key", "id", "tie", "at", "row", "text", "others"])

    def sort(table: pa.Table) -> pa.Table:
        """The spans of a shard, as many anchors at a time as fit one array."""
        table = table.take(pa.array(np.argsort(table.column("key").to_numpy(), kind="stable")))
        keys = table.column("key").to_numpy()
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        held = np.cumsum(pa.compute.binary_length(table.column("text")).to_numpy())
        out: list[pa.Table] = []
        start = 0
        while start < len(keys):
            below = held[start - 1] if start else 0
            fit = ends[(ends > start) & (held[ends - 1] <= below + ARRAY_BYTES)]
            stop = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, start, "right")])
            part = table.slice(start, stop - start).combine_chunks()
            found, sizes, masks = late_windows(part, length)
            told = part.select(["_batch", "others"]).take(pa.array(found))
            out.append(pa.table([told.column("_batch"), pa.array(sizes, pa.int32()), told.column("others"), pa.array(masks, pa.binary())], names=["_batch", "windows", "places", "mask"]))
            start = stop
        give_back()
        return pa.concat_tables(out)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = [id, "n_bytes", "n_removed", "removed", "kept"]
        spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in (table.schema.field(id).type, pa.int64(), pa.int64(), spans, pa.binary())], names=names)
        ids = table.column(id).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        table = table.take(pa.array(np.lexsort((table.column("_tie").to_numpy(), ids))))
        late: list[list[np.ndarray]] = [[] for _ in range(table.num_rows)]
        for n, places, mask in zip(*(answers.column(c).to_pylist() for c in ("windows", "places", "mask")), strict=True):
            first = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n))
            for k, (row, start) in enumerate(np.frombuffer(places, np.int64).reshape(-1, 2).tolist()):
                late[row].append(start + (np.arange(n) if k else first))
        sizes, gone, runs, kept = [], [], [], []
        for row, value in enumerate(table.column(text).to_pylist()):
            raw = (value or "").encode()
            at = np.sort(np.concatenate([np.zeros(0, np.int64), *late[row]]))
            new = np.append(True, np.diff(at) > length)[: len(at)]
            first = at[new]
            last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + length if len(at) else first
            edges = [0, *np.stack([first, last], 1).ravel().tolist(), len(raw)]
            left = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            sizes.append(len(raw))
            gone.append(len(raw) - len(left))
            runs.append([{"first": s, "last": e - 1} for s, e in zip(first.tolist(), last.tolist(), strict=True)])
            kept.append(left)
        give_back()
        return pa.table([table.column(id), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, spans), pa.array(kept, pa.binary())], names=names)

    anchors = rows.groupBy("_batch").applyInArrow(ask, ANCHORS)
    same = Window.partitionBy("anchor")
    count = F.col("batch_spans").bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    shared = anchors.select("anchor", "batch_spans", F.count("*").over(same).alias("n"), F.sum(count).over(same).alias("spans")).where("n > 1")
    shared = shared.select(F.shiftright("batch_spans", COUNT_BITS).alias("_batch"), "anchor", (F.col("spans") > hot_spans).alias("hot"))
    spans = rows.groupBy("_batch").cogroup(shared.groupBy("_batch")).applyInArrow(send, SPANS)
    answers = spans.groupBy(F.pmod(F.xxhash64("key"), F.lit(n_shards)).alias("shard")).applyInArrow(sort, ANSWERS)
    return rows.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(remove, kinds)
