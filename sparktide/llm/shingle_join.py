"""N-gram Jaccard self-join: a MinHash LSH forest proposes, exact set comparison decides.

Each text is a set of shingles (runs of five words).  A tree of the forest orders all signatures by a sequence of
MinHash values, a trie in which similar texts share long prefixes.  Matching starts at the deepest prefix and shortens it
until the chance that a pair at the threshold shares one in some tree reaches the target recall; shorter prefixes only
add candidates, so the tries are read once, at that depth.

Texts of the same words form one class and only its first member goes on.  Sharing a prefix makes classes neighbours,
and all true links lie inside the groups that neighbours form.  A group is compared in tiles of bounded size; a tile
returns numbers of links and a spanning forest, never pairs, so that what is written grows with the texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.llm.graph import components
from sparktide.llm.shared import give_back, stored, text_slices
from sparktide.llm.words import LOWER, Family, counts, mix, spans

#: Trees of the forest and values in the signature of one tree.
TREES, DEEPEST = 40, 10
#: Wanted chance that a pair at the threshold becomes a candidate.
RECALL = 0.99999
#: Texts in one tile, and texts of small groups that are compared in one call.
TILE, BUNDLE = 128, 400

_one, _two = Family(31), Family(32)


def prefix_length(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix, found by shortening, at which a pair at the threshold meets in some tree often enough."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles and their rows, in order, and two hashes of each row's words (0 where it has none).

    Words are runs of anything but ASCII white space, A-Z in lower case; a row with fewer than n words, but not none,
    is one shingle.
    """
    raw = LOWER[raw]
    start, end, row = spans(raw, offsets)
    rows = len(offsets) - 1
    size, first = counts(row, rows)
    one, two = _one.words(raw, start, end), _two.words(raw, start, end)
    whole = np.flatnonzero(size)
    keys = np.zeros((2, rows), np.uint64)
    keys[0, whole] = _one.windows(one, first[whole], size[whole])
    keys[1, whole] = _two.windows(two, first[whole], size[whole])
    number = np.arange(len(row)) - first[row]
    at = np.flatnonzero((number == 0) | (number + n <= size[row]))
    return _one.windows(one, at, np.minimum(n, size[row[at]])), row[at], keys[0], keys[1]


class Forest:
    """Hash functions of the trees; gives each row the hashes of its prefixes."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(33)
        self.trees, self.depth = trees, depth
        self.factor = rng.integers(1, 2**63, (trees, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.turn = rng.integers(0, 2**63, (trees, depth), dtype=np.uint64)

    def prefixes(self, hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Array of rows x trees; rows without shingles hold nothing of use."""
        out = np.zeros((rows, self.trees), np.uint64)
        if not len(hashes):
            return out
        has, first = np.unique(row, return_index=True)
        value = np.empty_like(hashes)
        for t in range(self.trees):
            label = np.full(len(has), t + 1, np.uint64)
            for d in range(self.depth):
                np.bitwise_xor(hashes, self.turn[t, d], out=value)
                np.multiply(value, self.factor[t, d], out=value)
                label = mix(label + np.minimum.reduceat(value, first))
            out[has, t] = label
        return out


def sketches(docs: DataFrame, n: int, forest: Forest) -> DataFrame:
    """(id, one, two, prefixes) per row; one and two, the hashes of all its words, are null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, offsets, raw in text_slices(batch.column(1)):
                rows = len(offsets) - 1
                hashes, row, one, two = shingles(raw, offsets, n)
                none = np.bincount(row, minlength=rows) == 0
                flat = forest.prefixes(hashes, row, rows).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows), pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none),
                        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * forest.trees), pa.array(flat)),
                    ],
                    names=["id", "one", "two", "prefixes"],
                )
        give_back()

    return docs.mapInArrow(run, "id long, one long, two long, prefixes array<long>")


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.names.index("text")
            rest = [i for i in range(batch.num_columns) if i != where]
            for first, offsets, raw in text_slices(batch.column(where)):
                rows = len(offsets) - 1
                hashes, row, _, _ = shingles(raw, offsets, n)
                edge = np.searchsorted(row, np.arange(rows + 1))
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, rows) for i in rest), pa.array(sets, pa.binary())], names=[*(batch.schema.names[i] for i in rest), "shingles"]
                )

    return run


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets of left and right (left itself if None) have a Jaccard similarity of the threshold or more."""
    both = left if right is None else left + right
    flat = np.concatenate(both)
    size = np.array([len(x) for x in both])
    owner = np.repeat(np.arange(len(both)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1  # a shingle of one set adds to no intersection
    column, owner = np.unique(column[many], return_inverse=True)[1], owner[many]
    a, common = len(left), np.zeros((len(left), len(both) - (0 if right is None else len(left))))
    for c in range(0, column.max() + 1 if len(column) else 0, 8192):
        s, e = np.searchsorted(column, [c, c + 8192])
        has = np.zeros((len(both), 8192), np.float32)
        has[owner[s:e], column[s:e] - c] = 1
        common += has[:a] @ (has if right is None else has[a:]).T
    rest = size if right is None else size[a:]
    return common >= threshold * (size[:a, None] + rest[None, :] - common) if threshold < 1 else common == size[:a, None] + rest[None, :] - common


def forest_of(near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each through the links of a symmetric matrix."""
    low = nodes.copy()
    while True:
        with_links = np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(low, with_links)
        if (new == low).all():
            return low
        low = new


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        raw = table.column("shingles").to_pylist()
        group, tile, node, copies = (table.column(c).to_numpy() for c in ("component", "tile", "node", "copies"))
        order = sorted(range(len(raw)), key=lambda k: (node[k], raw[k], copies[k]))
        order = [k for k, before in zip(order, [-1, *order], strict=False) if before < 0 or node[k] != node[before]]  # a repeated row counts once
        group, tile, node, copies = group[order], tile[order], node[order], copies[order]
        sets = [np.frombuffer(raw[k], np.uint64) for k in order]
        cross = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        out: list[np.ndarray] = []
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            if cross:
                a, b = at[tile[at] == table.column("lo")[0].as_py()], at[tile[at] == table.column("hi")[0].as_py()]
                if not len(a) or not len(b):
                    continue
                near = np.zeros((len(a) + len(b),) * 2, bool)
                near[: len(a), len(a) :] = linked([sets[i] for i in a], [sets[i] for i in b], threshold)
                near |= near.T
                at = np.concatenate([a, b])
            else:
                near = linked([sets[i] for i in at], None, threshold)
                np.fill_diagonal(near, False)
            links = near @ copies[at]
            some = links > 0
            out.append(np.stack([node[at], links, forest_of(near, node[at])])[:, some])
        rows = np.concatenate([np.zeros((3, 0), np.int64), *out], axis=1)
        return pa.table([pa.array(r) for r in rows.astype(np.int64)], names=["node", "links", "low"])

    return run


def near_duplicates(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, id: str = "doc_id", text: str = "text", trees: int = TREES, recall: float = RECALL, tile: int = TILE,
) -> DataFrame:
    """Per row: id, class_id, copies, n_links, component_id, kept.

    Two rows are linked if the Jaccard similarity of their shingle sets is at least the threshold.  class_id is the
    smallest id with the same words, copies the rows of that class, n_links the other rows linked with this one,
    component_id the smallest id reachable by links and kept whether it is the row's own.  Texts without words link with
    nothing.  Repeated rows are copies of each other and all kept or all dropped, as they have one id; a null id counts
    as the smallest of its class only if all are null, and such a row is kept if its class has no id.  No rows give none.
    """
    forest = Forest(trees, prefix_length(threshold, trees, DEEPEST, recall))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    made = stored(sketches(rows, n, forest), "sketches")
    worded = made.where("one IS NOT NULL")
    classes = worded.groupBy("one", "two").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    firsts = worded.join(classes.select(F.col("node").alias("id"), "one", "two"), ["id", "one", "two"], "left_semi")
    buckets = firsts.select(F.col("id").alias("node"), F.explode("prefixes").alias("prefix"))
    shared = buckets.groupBy("prefix").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("prefix", "low")
    groups = stored(components(buckets.join(shared, "prefix").select(F.col("node").alias("a"), F.col("low").alias("b")), "candidates"), "groups")
    bundles = max(1, groups.count() // BUNDLE)
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    members = (
        groups.join(sizes, "component").join(classes.select("node", "copies"), "node")
        .select("node", "copies", "component", "tiles", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"))
    )
    sets = rows.join(members, rows.id == members.node).drop("id")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.schema.fields if f.name != "text")
    sets = sets.mapInArrow(_sets(n), f"{kinds}, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    tiles = sets.select("*", other).select(
        F.when(F.col("tiles") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(bundles))).alias("g"), (F.col("tiles") > 1).alias("large"),
        F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "component", "tile", "node", "copies", "shingles",
    )
    found = stored(tiles.groupBy("g", "large", "lo", "hi").applyInArrow(_compare(threshold), "node long, links long, low long"), "links")
    reach = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), "linked")
    linked_classes = found.groupBy("node").agg(F.sum("links").alias("links")).join(reach, "node", "left")
    known = classes.join(linked_classes, "node", "left").select(
        "one", "two", "node", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    component = F.coalesce("component_id", "id")
    return made.select("id", "one", "two").join(known, ["one", "two"], "left").select(
        F.col("id").alias(id), F.coalesce("node", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
