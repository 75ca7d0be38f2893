"""Suffix arrays of byte strings by induced sorting, and permuted common prefixes, all in whole-array steps.

Suffixes are classified; a suffix is smaller-type (S) if it is smaller than the next one, and leftmost-smaller (LMS) if
the suffix before it is larger-type.  The substrings from one LMS position to the next are sorted by induction from
their first bytes and named; the order of the LMS suffixes follows from the names, level by level: a level names runs of
three names of the level below (two, where there are too many names for three in 64 bits), until all names differ or
cover the depth that is asked for.  From that order the whole
array is induced in two linear passes.  A pass goes through the buckets of first bytes and moves all suffixes of a
bucket at once; those that stay in the bucket follow in further steps, one for each repetition of the byte.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """True for S-type positions; the last one, the only end of text, is S-type."""
    n = len(text)
    smaller, larger = np.ones(n, bool), np.zeros(n, bool)
    smaller[:-1] = text[:-1] < text[1:]
    larger[:-1] = text[:-1] > text[1:]
    # among equal bytes the type is that of the next position where the byte changes
    at = np.where(smaller | larger, np.arange(n), n)
    return smaller[np.minimum.accumulate(at[::-1])[::-1]]


class Buckets:
    """Places of the suffixes by first byte, and the two passes that induce one type from the other."""

    def __init__(self, text: np.ndarray, s_type: np.ndarray):
        self.text, self.s_type = text, s_type
        self.count = np.bincount(text, minlength=256)
        self.end = np.cumsum(self.count)
        self.start = self.end - self.count
        self.array = np.empty(len(text), np.int32)

    def _push(self, suffixes: np.ndarray, want_s: bool, free: np.ndarray) -> None:
        """Place the suffixes before these that have the wanted type, in this order, at the free ends of their buckets."""
        before = suffixes[suffixes > 0] - 1
        before = before[self.s_type[before] == want_s]
        if not len(before):
            return
        first = self.text[before]
        order = np.argsort(first, kind="stable")
        first = first[order]
        number = np.bincount(first, minlength=256)
        rank = np.arange(len(first)) - (np.cumsum(number) - number)[first]
        if want_s:
            self.array[free[first] - 1 - rank] = before[order]
            free -= number
        else:
            self.array[free[first] + rank] = before[order]
            free += number

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """The array of all suffixes, from the LMS positions in the order that they are to have."""
        array, start, end = self.array, self.start, self.end
        first = self.text[lms]
        order = np.argsort(first, kind="stable")
        seeds, edge = lms[order], np.searchsorted(first[order], np.arange(257))
        head = start.copy()
        for c in np.flatnonzero(self.count):
            done = start[c]
            while done < head[c]:
                done, fresh = head[c], array[done : head[c]]
                self._push(fresh, False, head)
            self._push(seeds[edge[c] : edge[c + 1]], False, head)
        tail = end.copy()
        for c in np.flatnonzero(self.count)[::-1]:
            done = end[c]
            while done > tail[c]:
                done, fresh = tail[c], array[tail[c] : done][::-1]
                self._push(fresh, True, tail)
            self._push(array[start[c] : head[c]][::-1], True, tail)
        array[0] = len(self.text) - 1
        return array


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, the first one lowest."""
    return np.ndarray((len(text),), "<u8", buffer=np.concatenate([text, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A number for each LMS substring, in the order of `order`; equal substrings have equal numbers."""
    # the first byte of the next LMS substring belongs to this one
    length = np.empty(len(text), np.int32)
    length[lms] = np.diff(lms, append=len(text)) + 1
    words = _words(text)
    start, left = order, length[order]
    equal = left[1:] == left[:-1]
    active, step = np.flatnonzero(equal), 0
    first = words[order]
    differ = first[active] ^ first[active + 1]
    while len(active):
        spare = np.maximum(0, 8 - (left[active] - step)).astype(np.uint64) * np.uint64(8)
        same = (differ << spare) == 0
        equal[active[~same]] = False
        step += 8
        active = active[same & (left[active] > step)]
        differ = words[np.minimum(start[active] + step, len(text) - 1)] ^ words[np.minimum(start[active + 1] + step, len(text) - 1)]
    name = np.zeros(len(order), np.int64)
    name[1:] = np.cumsum(~equal)
    out = np.empty(len(text), np.int64)
    out[order] = name
    return out[lms]


def _ranks(names: np.ndarray, depth: int) -> np.ndarray:
    """Order numbers of the suffixes of a string of names, by at least their first `depth` names.

    A number is one more than the suffixes before all equal ones, so a level renumbers only what is still equal.
    """
    n, covered = len(names), 1
    times = np.bincount(names)
    rank = (np.cumsum(times) - times)[names] + 1
    equal = np.flatnonzero(times[names] > 1)
    while len(equal) and covered < depth:
        padded = np.concatenate([rank, np.zeros(2 * covered, np.int64)])
        own = rank[equal]
        key, runs = own * (n + 1) + padded[equal + covered], 2
        if n + 1 < 1 << 21:
            key, runs = key * (n + 1) + padded[equal + 2 * covered], 3
        order = np.argsort(key, kind="stable")
        key, own, at = key[order], own[order], np.arange(len(order))
        first, new = np.ones(len(order), bool), np.ones(len(order) + 1, bool)
        first[1:], new[1:-1] = own[1:] != own[:-1], key[1:] != key[:-1]
        behind = np.maximum.accumulate(np.where(new[:-1], at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        rank[equal[order]] = own + behind
        equal = equal[order[~(new[:-1] & new[1:])]]
        covered *= runs
    return rank


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions of text in the order of their suffixes, by their first `depth` bytes at least.

    text holds bytes (uint8), at most 2 ** 31, and must end with a 0.
    """
    s_type = classify(text)
    is_lms = s_type.copy()
    is_lms[0] = False
    is_lms[1:] &= ~s_type[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    buckets = Buckets(text, s_type)
    found = buckets.induce(lms)
    names = _names(text, lms, found[is_lms[found]])
    # two neighbouring LMS positions are two bytes apart at least
    rank = _ranks(names, len(text) if depth is None else -(-depth // 2) + 1)
    return Buckets(text, s_type).induce(lms[np.argsort(rank, kind="stable")])


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Equal bytes from a and from b on, at most limit; words has the eight bytes from each position on."""
    out = np.zeros(len(a), np.int64)
    active, step = np.arange(len(a)), 0
    while len(active):
        x = words[a[active] + step] ^ words[b[active] + step]
        same = x == 0
        x, at = x[~same], active[~same]
        low = x & (~x + np.uint64(1))
        out[at] = step + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        step += 8
        active = active[same]
        out[active] = step
        active = active[limit[active] > step]
    return np.minimum(out, limit)


def common_prefixes(text: np.ndarray, array: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each position, in text order: equal bytes with the suffix before it in the array, at most `room` of both.

    Where the suffix before follows that of the position before, the number is one less than there, so only the
    positions that start such a chain are compared.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = n - 1
    words = _words(text)
    starts = np.ones(n, bool)
    starts[1:] = before[1:] != before[:-1] + 1
    starts[array[0]] = False  # no suffix stands before the first
    if array[0] + 1 < n:
        starts[array[0] + 1] = True
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(starts)
    out[at] = _common(words, at, before[at], np.minimum(room[at], room[before[at]]))
    head = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    out = out[head] - (np.arange(n) - head)
    again = np.flatnonzero(out < 0)
    again = again[again != array[0]]
    out[again] = _common(words, again, before[again], np.minimum(room[again], room[before[again]]))
    out[array[0]] = 0
    return out
