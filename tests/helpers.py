"""Small sample frames for the tests."""

from datetime import datetime, timedelta, timezone

from sparktide.schema import SAMPLES, normalize_samples

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return EPOCH + timedelta(seconds=seconds)


def samples(spark, rows):
    """rows: (name, labels, seconds, value[, seq[, anomalous]])."""
    out = []
    for i, r in enumerate(rows):
        name, labels, sec, value = r[:4]
        seq = r[4] if len(r) > 4 and r[4] is not None else i
        out.append((name, labels, at(sec), float(value), 1.0, r[5] if len(r) > 5 else False, seq))
    return normalize_samples(spark.createDataFrame(out, SAMPLES))


def rel(ts):
    """Seconds since the tests' epoch of a collected timestamp."""
    return (ts.replace(tzinfo=timezone.utc) - EPOCH).total_seconds()
