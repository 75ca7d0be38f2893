"""Plain versions of the operators, for small inputs."""

import re
from itertools import combinations

SPACES = " \t\n\v\f\r"


def words(text):
    return [w for w in re.split(f"[{SPACES}]+", text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def substring(rows, size=13):
    """{id: (kept words, removed)} for (id, text) rows with ids."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            s = tuple(w[k : k + size])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, [x for k, x in enumerate(w) if k not in gone], len(gone)))
    return out


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def groups(n, links):
    """Smallest number reachable from each."""
    low = list(range(n))
    while True:
        new = low[:]
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def jaccard_links(texts, threshold=0.8, n=5):
    sets = [shingles(t, n) for t in texts]
    return [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]


def normal_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(text, items, size=13):
    """(words, hits, items found) with items a list of (id, text)."""
    w = normal_words(text)
    hit, found = set(), set()
    for item, t in items:
        x = normal_words(t)
        for k in range(max(1, len(x) - size + 1)) if x else []:
            run = x[k : k + size]
            for j in range(len(w) - len(run) + 1):
                if w[j : j + len(run)] == run:
                    hit.update(range(j, j + len(run)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)
