"""Words and windows of words as 64-bit hashes, computed for whole slices of text at once."""

from __future__ import annotations

import numpy as np

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes with A-Z turned to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        full = np.full(max(n + 1, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=np.uint64)
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each input bit reaches each output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Family:
    """One family of hashes: values of the byte alphabet and two odd bases, drawn from a seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.bases = [int(x) | 1 for x in rng.integers(2**40, 2**62, 2)]

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int | None = None) -> np.ndarray:
        """Hash of values[start:end], wherever the range stands.

        A sum of values times rising powers of the base; the inverse power of the place where the range starts takes
        the place out again.
        """
        n, base = len(values), base or self.bases[0]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(base, n)[:n], out=total[1:], dtype=np.uint64)
        return mix((total[end] - total[start]) * _power(pow(base, -1, 1 << 64), n)[start])

    def words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each word raw[start:end]."""
        return self.ranges(self.table[raw], start, end, self.bases[0])

    def windows(self, words: np.ndarray, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """One hash for each run of `size` words starting at word number `first`."""
        return self.ranges(words, first, first + size, self.bases[1])


def spans(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word never crosses from one row to the next."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = separators[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(raw), bool)
    before[1:] = gap[:-1]
    start = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.ones(len(raw), bool)
    after[:-1] = gap[1:]
    end = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def counts(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending row numbers of words: words per row, and the first word of each row."""
    size = np.bincount(rows, minlength=n).astype(np.int64)
    return size, np.cumsum(size) - size
