"""Remote-write bodies (Snappy block, protobuf WriteRequest) to samples and back.

The format is a byte stream, so the decoding itself runs in Python inside
``mapInArrow``; it is a helper of a few lines per body while Spark spreads the
bodies.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: sampling interval assumed for pushed samples, in seconds.
PUSH_INTERVAL_S = 15.0

_DECODED = "name string, labels map<string,string>, ts_ms bigint, value double, body_no bigint, error string"
_ENCODED = "body binary"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message; nested messages stay bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        if at > len(data):
            raise ValueError("message ends early")
        yield tag >> 3, value


def _read_body(body: bytes) -> list[tuple[str, dict, int, float]]:
    size, _ = _varint(body, 0)
    data = pa.Codec("snappy").decompress(body, decompressed_size=size, asbytes=True) if size else b""
    out = []
    for field, series in _fields(data):
        if field != 1:
            continue
        labels, samples = {}, []
        for number, part in _fields(series):
            if number == 1:
                pair = {k: v.decode() for k, v in _fields(part)}
                labels[pair.get(1, "")] = pair.get(2, "")
            elif number == 2:
                point = dict(_fields(part))
                value = struct.unpack("<d", point[1])[0] if 1 in point else 0.0
                stamp = point.get(2, 0)
                samples.append((stamp - (1 << 64) if stamp >= 1 << 63 else stamp, value))
        name = labels.pop("__name__", "")
        if name:
            out += [(name, labels, stamp, value) for stamp, value in samples]
    return out


#: Samples that one batch out of the decoder has at most, besides the last body's.
DECODED_ROWS = 50_000


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body, number in zip(batch["body"], batch["body_no"]):
            if len(rows) >= DECODED_ROWS:
                yield _rows_out(rows)
                rows = []
            number = number.as_py()
            try:
                rows += [(*r, number, None) for r in _read_body(body.as_py())]
            except (ValueError, IndexError, TypeError, AttributeError, struct.error, OSError) as problem:
                rows.append((None, {}, None, None, number, str(problem) or type(problem).__name__))
        yield _rows_out(rows)


def _rows_out(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 6
    types = (pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.float64(), pa.int64(), pa.string())
    arrays = [pa.array([list(m.items()) for m in c] if pa.types.is_map(t) else list(c), t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, ["name", "labels", "ts_ms", "value", "body_no", "error"])


def _decoded(bodies: DataFrame, number: str | None) -> DataFrame:
    no = F.col(number).cast("long") if number else F.lit(None).cast("long")
    return bodies.select("body", no.alias("body_no")).mapInArrow(_decode, _DECODED)


def decode_remote_write(bodies: DataFrame, number: str | None = None) -> DataFrame:
    """Samples of all readable bodies; series without a name are skipped.

    A body is taken whole or not at all; see :func:`remote_write_rejects`.
    ``number`` names an id column of the bodies to carry along as ``body_no``.
    """
    good = _decoded(bodies, number).where(F.col("error").isNull())
    return good.select(
        "name", "labels", F.timestamp_millis("ts_ms").alias("ts"), "value",
        F.lit(PUSH_INTERVAL_S).alias("interval_s"), *(["body_no"] if number else []),
    )


def remote_write_rejects(bodies: DataFrame, number: str) -> DataFrame:
    """Ids of the bodies that could not be read, with the reason."""
    return _decoded(bodies, number).where(F.col("error").isNotNull()).select("body_no", "error")


def _put_varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _put(field: int, payload: bytes) -> bytes:
    return _put_varint(field << 3 | 2) + _put_varint(len(payload)) + payload


def _write_series(labels: list[dict], samples: list[dict]) -> bytes:
    named = b"".join(_put(1, _put(1, e["key"].encode()) + _put(2, e["value"].encode())) for e in labels)
    points = b"".join(
        _put(2, b"\x09" + struct.pack("<d", s["value"]) + b"\x10" + _put_varint(s["ts_ms"])) for s in samples
    )
    return _put(1, named + points)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for labels, samples in zip(batch["labels"].to_pylist(), batch["samples"].to_pylist()):
            packed.append(pa.Codec("snappy").compress(_write_series(labels, samples), asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["body"])


def encode_remote_write(batches: DataFrame) -> DataFrame:
    """Wire bodies of series batches (see ``sinks.matrix.timeseries_batches``)."""
    return batches.select("labels", "samples").mapInArrow(_encode, _ENCODED)
