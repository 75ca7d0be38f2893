"""Near-duplicate vectors: tiles compared along principal axes, given up as soon as the cosine cannot reach the threshold.

All vectors are scaled to length one and turned to their principal axes, the axis of most variance first, so that a
product of two is mostly in its first terms.  Vectors of a label are cut into tiles of bounded size along the first
axis.  Vectors with cosine t are at most sqrt(2 - 2t) apart on every axis, so tiles whose boxes lie further apart are
never paired.  Within a pair of tiles the products are summed over a few axes at a time; what the remaining axes can add
is at most the product of the two remaining norms, and pairs that cannot reach the threshold any more drop out.  Those
left are decided by the cosine of the vectors as given, in double precision.

Equal vectors of a label go on as one.  A pair of tiles returns numbers of links and a spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktide.llm.graph import components
from sparktide.llm.shared import stored
from sparktide.llm.shingle_join import forest_of

#: Vectors in one tile, and axes that are added at a time.
TILE, STEP = 512, 8
#: Allowance for rounding in sums of products of unit vectors; pairs within it are decided exactly.
SLACK = 1e-9


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, as given."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def axes_of(vectors: DataFrame, size: int, column: str = "v") -> np.ndarray:
    """Principal axes of the unit vectors, as columns, by falling variance: every task sums its outer products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = unit(_matrix(batch.column(0)))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([i * size + j for i in range(size) for j in range(size)], pa.int32()), pa.array(total.ravel())], names=["i", "s"])

    sums = vectors.select(column).mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # size x size numbers
    moment = np.zeros(size * size)
    for r in sums:
        moment[r["i"]] = r["s"]
    values, axes = np.linalg.eigh(moment.reshape(size, size))
    return axes[:, np.argsort(-values, kind="stable")]


def near_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y with a cosine of the threshold or more."""
    a, b = unit(x) @ axes, unit(y) @ axes
    rest_a = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0))
    some_a, some_b = np.arange(len(a)), np.arange(len(b))
    total = np.zeros((len(a), len(b)))
    open_ = np.ones_like(total, bool)
    for k in range(0, a.shape[1], step):
        total += a[some_a, k : k + step] @ b[some_b, k : k + step].T
        last = k + step >= a.shape[1]
        bound = 0 if last else rest_a[some_a, k + step][:, None] * rest_b[some_b, k + step][None, :]
        open_ &= total + bound >= threshold - SLACK
        rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(rows):
            return rows, rows
        if len(rows) * len(columns) < 0.7 * total.size:
            total, open_ = total[np.ix_(rows, columns)], open_[np.ix_(rows, columns)]
            some_a, some_b = some_a[rows], some_b[columns]
    i, j = np.nonzero(open_)
    i, j = some_a[i], some_b[j]
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 20_000):
        out[s : s + 20_000] = cosines(x[i[s : s + 20_000]], y[j[s : s + 20_000]]) >= threshold
    return i[out], j[out]


def _compare(axes: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, ids, vectors, copies, other_ids, other_vectors, other_copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = len(axes)
                x, y = (np.frombuffer(v, "<f4").reshape(-1, size).astype(np.float64) for v in (vectors, other_vectors))
                node, weight = np.frombuffer(ids, "<i8"), np.frombuffer(copies, "<i8")
                i, j = near_pairs(x, y, axes, threshold)
                if one != two:
                    node, weight = np.concatenate([node, np.frombuffer(other_ids, "<i8")]), np.concatenate([weight, np.frombuffer(other_copies, "<i8")])
                    j = j + len(x)
                near = np.zeros((len(node),) * 2, bool)
                near[i, j] = near[j, i] = True
                np.fill_diagonal(near, False)
                links, low = near @ weight, forest_of(near, node)
                some = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (node, links, low)], names=["node", "links", "low"])

    return run


def _tiles(axes: np.ndarray, tile: int, cell: float):
    """Tiles of one label each from partitions sorted by label and first axis."""
    names = ["tile", "label", "low", "high", "box_low", "box_high", "ids", "vectors", "copies"]

    def emit(part: int, number: int, label, x: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
        turned = unit(x) @ axes[:, :4]
        values = [
            (part << 32) | number, label, int(np.floor(turned[:, 0].min() / cell)), int(np.floor(turned[:, 0].max() / cell)), turned.min(axis=0).tolist(), turned.max(axis=0).tolist(),
            ids.astype("<i8").tobytes(), x.astype("<f4").tobytes(), copies.astype("<i8").tobytes(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, KINDS, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # of one label, fewer than a tile
        label = None
        for batch in batches:
            labels, x = batch.column(0).to_pylist(), _matrix(batch.column(2))
            ids, copies = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            for k in range(batch.num_rows):
                if held and (labels[k] != label or len(held) == tile):
                    yield emit(part, number, label, *(np.array(v) for v in zip(*held, strict=True)))
                    held, number = [], number + 1
                label = labels[k]
                held.append((x[k], ids[k], copies[k]))
        if held:
            yield emit(part, number, label, *(np.array(v) for v in zip(*held, strict=True)))

    return run


KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
TILES = "tile long, label string, low long, high long, box_low array<double>, box_high array<double>, ids binary, vectors binary, copies binary"


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE,
) -> DataFrame:
    """Per row: id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null and the cosine of their vectors is at least the threshold.
    n_links counts the other rows linked, component_id is the smallest id reachable by links, kept whether that is the
    row's own.  Vectors that are null, empty, zero or hold null or non-finite components, and those without label or id,
    link with nothing; vectors of other lengths link only with their own length.  Repeated rows are links of each other.
    No rows give none.  Other columns are ignored.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.col(label).cast("string").alias("label"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    usable = rows.where(F.coalesce(fine, F.lit(False)))
    keyed = usable.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0).cast("float")))  # -0.0 and 0.0 are one
    classes = stored(keyed.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "vectors")
    lengths = [r[0] for r in classes.select(F.size("v").alias("n")).distinct().collect()]
    found = None
    for n in sorted(lengths):
        part = _links(classes.where(F.size("v") == n), n, threshold, tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "links")
    # a cosine of equal vectors is one but for rounding: copies are linked with each other
    reach = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")), "linked")
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(reach, "node", "left")
    known = classes.join(linked, "node", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    joined = keyed.join(known, ["label", "v"]).select("id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(rest).select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, size: int, threshold: float, tile: int) -> DataFrame:
    """(node, links, low) of distinct vectors of one length: parts of numbers of links, and edges that join components."""
    axes = axes_of(classes, size)
    reach = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + 1e-6
    first = axes[:, 0]
    dot = F.aggregate(F.zip_with("v", F.array(*(F.lit(float(a)) for a in first)), lambda c, a: c.cast("double") * a), F.lit(0.0), lambda s, c: s + c)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    ordered = classes.withColumn("axis", dot / norm).repartitionByRange("label", "axis", "node").sortWithinPartitions("label", "axis", "node")
    tiles = stored(ordered.select("label", "node", "v", "copies").mapInArrow(_tiles(axes, tile, max(reach, 1e-3)), TILES), "tiles")
    meta = tiles.select("tile", "label", "low", "high", "box_low", "box_high")
    cells = meta.select("*", F.explode(F.sequence("low", "high")).alias("cell"))
    near = cells.select("*", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("near")).drop("cell")
    a, b = near.alias("a"), cells.alias("b")
    apart = F.aggregate(
        F.zip_with(F.zip_with("a.box_low", "b.box_high", lambda p, q: F.greatest(p - q, F.lit(0.0))), F.zip_with("b.box_low", "a.box_high", lambda p, q: F.greatest(p - q, F.lit(0.0))), lambda p, q: p + q),
        F.lit(0.0), lambda s, c: s + c * c,
    )
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.near") == F.col("b.cell")) & (F.col("a.tile") <= F.col("b.tile"))
    pairs = a.join(b, same).where(apart <= reach * reach).select(F.col("a.tile").alias("one"), F.col("b.tile").alias("two")).distinct()
    left = tiles.select(F.col("tile").alias("one"), "ids", "vectors", "copies")
    right = tiles.select(F.col("tile").alias("two"), *(F.col(c).alias(f"other_{c}") for c in ("ids", "vectors", "copies")))
    both = pairs.join(left, "one").join(right, "two").select("one", "two", "ids", "vectors", "copies", "other_ids", "other_vectors", "other_copies")
    return both.mapInArrow(_compare(axes, threshold), "node long, links long, low long")
