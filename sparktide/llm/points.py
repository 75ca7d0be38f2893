"""Slices of text as code points, and hashed runs of them."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows, and where each row starts among them."""
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    text = raw.tobytes().decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), lead[offsets]


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is none."""
    signs = map(chr, range(sys.maxunicode + 1))
    return np.fromiter((ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in signs), np.uint32, sys.maxunicode + 1)


_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def grams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hash of `bits` bits for each run of n code points, wherever rows end."""
    size = max(len(points) - n + 1, 0)
    key = np.full(size, n, np.uint32)
    for i in range(n):
        key = (key ^ points[i : i + size]) * _FACTORS[i]
        key ^= key >> np.uint32(15)
    return (key * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)


def row_sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges; runs may be empty."""
    total = np.zeros(len(edge) - 1)
    some = np.flatnonzero(edge[1:] > edge[:-1])
    if len(some):
        total[some] = np.add.reduceat(values[: edge[-1]], edge[some])
    return total
