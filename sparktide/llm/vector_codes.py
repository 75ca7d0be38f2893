"""Vector codes: each of several parts of a vector becomes the number of the nearest entry of that part's codebook.

Components are integers.  A block of rows holds, for each dimension, the dictionary of its distinct integers and the
rows as places in these dictionaries.  A round tabulates, for each dimension, the squared difference of every integer
of the dictionary to all entries; the distances of all rows are then gathers from these tables and adds, and no row is
multiplied.  The blocks are built once, written to the shared folder and read by each round.

A round sends its entries to the tasks (parts x entries x components) and gets one sum and count for each of them from
each task; neither grows with the table, and no key of the table is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktide.llm.shared import bounded_batches, give_back, stored

#: Rows of one block; a dictionary has at most as many integers.
BLOCK_ROWS = 4096

#: Integers beyond this are set to it, so that squared distances fit 64 bits.
LARGEST = 1 << 27

SUMS = "part int, entry int, place int, n long, total long"


def whole_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor holds null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)))


def integers(column: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of all components, one row a vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64).reshape(len(column), dims)


def part_edges(dims: int, parts: int) -> list[int]:
    """Where the parts start and end; the last ones are shorter if they cannot be equal."""
    size = -(-dims // parts)
    return [min(dims, k * size) for k in range(parts + 1)]


class Block:
    """Rows as places in one dictionary for each dimension."""

    def __init__(self, values: list[np.ndarray], places: np.ndarray):
        self.values, self.places = values, places

    @classmethod
    def of(cls, rows: np.ndarray) -> Block:
        values, places = [], np.empty(rows.shape[::-1], np.uint16)
        for d in range(rows.shape[1]):
            distinct, at = np.unique(rows[:, d], return_inverse=True)
            values.append(distinct)
            places[d] = at
        return cls(values, places)

    @classmethod
    def read(cls, row: dict) -> Block:
        sizes = np.frombuffer(row["sizes"], np.int32)
        values = np.split(np.frombuffer(row["values"], np.int32).astype(np.int64), np.cumsum(sizes)[:-1]) if len(sizes) else []
        return cls(values, np.frombuffer(row["places"], np.uint16).reshape(len(sizes), len(row["ids"])))

    def written(self) -> tuple[bytes, bytes, bytes]:
        flat = np.concatenate([np.zeros(0, np.int32), *(v.astype(np.int32) for v in self.values)])
        return np.array([len(v) for v in self.values], np.int32).tobytes(), flat.tobytes(), self.places.tobytes()

    def nearest(self, entries: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry, the lowest of equal ones, and the squared distance to it, for one part."""
        distance = np.zeros((self.places.shape[1], len(entries)), np.int64)
        for d in range(entries.shape[1]):
            table = (self.values[first + d][:, None] - entries[None, :, d]) ** 2
            distance += table[self.places[first + d]]
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(best)), best]

    def add_sums(self, best: np.ndarray, first: int, counts: np.ndarray, totals: np.ndarray) -> None:
        """Add the rows of each entry to its count and its sum for each dimension, counted by integer."""
        counts += np.bincount(best, minlength=len(counts))
        for d in range(totals.shape[1]):
            values = self.values[first + d]
            times = np.bincount(best * len(values) + self.places[first + d], minlength=len(counts) * len(values))
            totals[:, d] += times.reshape(len(counts), -1) @ values


def as_blocks(vectors: DataFrame, id: str, vector: str, label: str, dims: int, scale: int) -> DataFrame:
    """Blocks of at most BLOCK_ROWS rows with ids and labels, in the shared folder."""
    kinds = T.StructType([
        T.StructField("ids", T.ArrayType(vectors.schema[id].dataType)), T.StructField("labels", T.ArrayType(vectors.schema[label].dataType)),
        *T.StructType.fromDDL("sizes binary, values binary, places binary").fields,
    ])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            ids, labels, column = (rows.column(k).combine_chunks() for k in range(3))
            sizes, values, places = Block.of(integers(column, dims, scale)).written()
            ends = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), *(pa.array([x], pa.binary()) for x in (sizes, values, places))],
                names=["ids", "labels", "sizes", "values", "places"],
            )

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                if held + piece.num_rows > BLOCK_ROWS:
                    yield block()
                    waiting, held = [], 0
                waiting.append(piece)
                held += piece.num_rows
        if held:
            yield block()
        give_back()

    return stored(vectors.select(id, label, vector).mapInArrow(build, kinds), "vector-blocks")


def entry_sums(blocks: DataFrame, books: list[np.ndarray], edges: list[int]) -> DataFrame:
    """Count and sums of the vectors nearest to each entry; one row a task, part, entry and component is shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                for p, entries in enumerate(books):
                    block.add_sums(block.nearest(entries, edges[p])[0], edges[p], counts[p], totals[p])
        out = [
            (p, k, d, int(counts[p][k]), int(totals[p][k, d]))
            for p, entries in enumerate(books) for k in range(len(entries)) if counts[p][k] for d in range(entries.shape[1])
        ]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["part", "entry", "place", "n", "total"])

    wide = blocks.mapInArrow(sums, SUMS).withColumn("total", F.col("total").cast("decimal(38,0)"))
    return wide.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def nearest_codes(blocks: DataFrame, books: list[np.ndarray], edges: list[int], id: str, label: str) -> DataFrame:
    """id, label, code and error of each vector."""
    ids, labels = blocks.schema["ids"].dataType.elementType, blocks.schema["labels"].dataType.elementType
    kinds = T.StructType([T.StructField(id, ids), T.StructField(label, labels), *T.StructType.fromDDL("code string, error long").fields])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["ids", "sizes", "values", "places"]).to_pylist()):
                block = Block.read(row)
                error, digits = np.zeros(len(row["ids"]), np.int64), []
                for p, entries in enumerate(books):
                    best, distance = block.nearest(entries, edges[p])
                    digits.append(best.astype(np.uint8))
                    error += distance
                text = np.stack(digits, axis=1).tobytes().hex()
                step = 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array([text[k : k + step] for k in range(0, len(text), step)], pa.string()), pa.array(error, pa.int64())],
                    names=[id, label, "code", "error"],
                )
        give_back()

    return stored(blocks.mapInArrow(codes, kinds), "vector-codes")


def book_text(books: list[np.ndarray]) -> str:
    """All integers by part, entry and position, joined by commas."""
    return ",".join(str(int(x)) for b in books for x in b.ravel())


def compress_vectors(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
    id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Per vector: id, label, code, error, label_error, codebooks.

    Components become floor(scale * x).  The first codebooks are the parts of the `entries` smallest ids (ties by the
    vector, a null id last).  Each round replaces an entry by the floor of the mean of the parts nearest to it; an entry
    without parts stays.  Then each vector's code has two hex digits a part, its error is the sum of squared distances,
    and label_error sums the errors of equal labels; null is a label of its own.  codebooks holds all final integers as
    text, the same in each row.

    Vectors that are null or hold null or non-finite components have no row, nor have those of another length than the
    first vector's.  Fewer vectors than entries make smaller codebooks; repeated ids are rows of their own; parts are
    shorter at the end if the length is no multiple of `parts`, and may be empty; integers beyond 2 ** 27 are set to
    that.  No vectors give no rows.  Other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits needs between 1 and 256 entries")
    spark = vectors.sparkSession
    bounded_batches(spark)
    kinds = T.StructType([vectors.schema[id], vectors.schema[label], *T.StructType.fromDDL("code string, error long, label_error long, codebooks string").fields])
    fine = whole_vectors(vectors.select(id, label, vector), vector)
    by_id = [F.col(id).asc_nulls_last(), F.col(vector).asc()]
    first = fine.orderBy(*by_id).limit(1).collect()
    if not first:
        return spark.createDataFrame([], kinds)
    dims = len(first[0][vector])
    fine = fine.where(F.size(vector) == dims)
    start = fine.orderBy(*by_id).limit(entries).select(vector).collect()  # at most `entries` vectors
    edges = part_edges(dims, parts)
    rows = integers(pa.array([r[0] for r in start], pa.list_(pa.float64())), dims, scale)
    books = [rows[:, a:b].copy() for a, b in zip(edges, edges[1:], strict=False)]
    blocks = as_blocks(fine, id, vector, label, dims, scale)
    for _ in range(rounds):
        new = [b.copy() for b in books]
        for r in entry_sums(blocks, books, edges).collect():  # at most entries x dims rows
            new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = new
    coded = nearest_codes(blocks, books, edges, id, label)
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded[label].eqNullSafe(sums["_label"])).select(id, label, "code", "error", "label_error", F.lit(book_text(books)).alias("codebooks"))

