"""Seconds, buckets, durations and query times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def unix_second(ts: Column | str) -> Column:
    """Whole second of a timestamp, floored also before 1970."""
    return F.unix_seconds(ts)


def floor_to(sec: Column, width_s: int) -> Column:
    """Start second of the fixed-width bucket a second falls in (integer maths)."""
    width = F.lit(int(width_s)).cast("long")
    return sec - F.pmod(sec, width)


def bucket_start(ts: Column | str, width_s: int) -> Column:
    return F.timestamp_seconds(floor_to(unix_second(ts), width_s))


# Seconds per duration unit, a year being 365 days.
UNIT_SECONDS = {
    "ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3,
    "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "y": 31536000.0,
}

_CLOCK_PART = r"(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h)"
_CLOCK = rf"^[+-]?(?:0|(?:{_CLOCK_PART})+)$"
_DAYS = r"^\d+[dy]$"


def duration_seconds(text: str) -> float:
    """Seconds of ``15s``, ``1h30m``, ``7d`` or ``1y``; ValueError otherwise."""
    if not (re.match(_DAYS, text) or re.match(_CLOCK, text)):
        raise ValueError(f"invalid duration {text!r}")
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h|d|y)", text)
    total = sum(float(n) * UNIT_SECONDS[u] for n, u in parts)
    return -total if text.startswith("-") else total


def parse_duration(text: Column) -> Column:
    """Column form of :func:`duration_seconds`; null for invalid text."""
    part = F.lit(r"((?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h|d|y))")
    units = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])

    def seconds(p: Column) -> Column:
        number = F.regexp_extract(p, r"^[0-9.]+", 0).try_cast("double")
        return number * F.try_element_at(units, F.regexp_replace(p, r"^[0-9.]+", ""))

    total = F.aggregate(F.regexp_extract_all(text, part, F.lit(1)), F.lit(0.0), lambda a, p: a + seconds(p))
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    return F.when(text.rlike(_DAYS) | text.rlike(_CLOCK), signed)


_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def parse_time(text: Column) -> Column:
    """Query time: unix seconds (may be fractional) or an RFC 3339 stamp; else null.

    Seconds count up to 9.2e9 on either side of 1970 (years 1678 to 2261), what
    a nanosecond clock of 64 bits can tell; beyond, the time is null.
    """
    seconds = text.try_cast("double")
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 9.2e9)
    number = F.timestamp_micros(F.when(finite, F.floor(seconds * MICROS)))
    stamp = F.when(text.rlike(_RFC3339), F.upper(text)).try_cast("timestamp")
    return F.coalesce(number, stamp)
