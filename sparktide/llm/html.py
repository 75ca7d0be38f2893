"""Main text of web pages: flat text blocks, judged by a small decision tree.

A page becomes a flat list of blocks.  Each has its words, its link density (the share of its words inside links), the
same of the block before and after it, whether an element around it is by its name, class, id or role one for menus,
adverts, notices, comments and the like, and whether it stands in an article.  A form, or an element marked by a word of
its class or id only, counts for nothing if it holds an article or most words of the page.  A tree grown from the labelled blocks
below says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)

#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title textarea select option button audio video".split())
#: Elements that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that are kept open until their end tag, as they tell where a block stands.
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul span a".split())
#: Signs that are white space, not part of a word, between the parts of a block.
SPACING = frozenset("br td th wbr".split()) - {"wbr"}

#: Names of elements and roles, and words of classes and ids, around what is not main text; the first kind stays even
#: around an article, the second ends where an article begins.
ASIDE = frozenset(
    "aside nav footer form dialog menu navigation complementary contentinfo search sidebar comment comments respond reply replies discussion disqus"
    " related breadcrumb breadcrumbs pagination pager share sharing social navbar widget newsletter subscribe signup login".split()
)
BEFORE = frozenset(
    "header banner masthead ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice notices alert popup modal overlay toolbar topbar copyright disclaimer legal skip".split()
)
MAIN = frozenset(("article", "main"))
#: Words of classes and ids that stay whatever the element holds; only these mark an article.
COMMENTS = frozenset("comment comments respond reply replies discussion disqus".split())

#: Labelled blocks: words, link density, words and link density before, words and link density after, 1 in an element of
#: the lists above and 2 if it is hidden or for comments, 1 in an article, and 1 for main text.  Made up for this purpose.
LABELLED = """
1 1.0 0 0.0 1 1.0 1 0 0
1 1.0 1 1.0 1 1.0 1 0 0
2 1.0 1 1.0 2 1.0 1 0 0
1 1.0 1 1.0 5 0.0 1 0 0
5 0.0 1 1.0 9 0.0 1 0 0
14 0.0 2 1.0 7 0.0 1 0 0
40 0.0 1 1.0 12 0.0 1 0 0
11 0.0 38 0.0 0 0.0 1 0 0
6 0.2 60 0.0 0 0.0 1 0 0
25 0.3 4 0.0 3 0.5 1 0 0
3 0.0 2 0.0 1 0.0 1 0 0
80 0.0 6 0.0 90 0.0 1 0 0
4 0.0 70 0.0 50 0.0 1 1 0
30 0.0 25 0.0 18 0.0 1 1 0
2 1.0 3 1.0 2 1.0 1 1 0
60 0.1 40 0.0 10 0.0 1 1 0
1 0.0 45 0.0 30 0.0 1 1 0
150 0.0 120 0.0 140 0.0 1 0 1
110 0.02 60 0.0 90 0.0 1 0 1
240 0.05 8 0.0 130 0.0 1 0 1
130 0.0 150 0.0 6 0.0 1 1 1
170 0.04 90 0.0 100 0.0 1 1 1
150 0.0 120 0.0 140 0.0 2 0 0
60 0.0 40 0.0 30 0.0 2 0 0
12 0.0 50 0.0 45 0.0 2 0 0
150 0.0 120 0.0 140 0.0 2 1 0
170 0.04 90 0.0 100 0.0 2 1 0
9 0.0 5 0.0 60 0.0 2 1 0
9 0.0 5 0.0 60 0.0 0 1 1
1 0.0 9 0.0 44 0.0 0 1 1
2 0.0 50 0.0 1 0.0 0 1 1
1 0.0 1 0.0 1 0.0 0 1 1
70 0.0 12 0.0 85 0.0 0 1 1
120 0.05 60 0.0 40 0.1 0 1 1
35 0.4 50 0.0 60 0.0 0 1 1
12 0.8 50 0.0 60 0.0 0 1 1
3 1.0 55 0.0 60 0.0 0 1 1
400 0.0 9 0.0 11 0.0 0 1 1
8 0.0 0 0.0 30 0.0 0 1 1
7 0.0 1 1.0 55 0.0 0 1 1
10 0.0 50 0.0 0 0.0 0 1 1
3 0.0 2 1.0 40 0.0 0 1 1
2 0.0 1 1.0 1 0.0 0 1 1
4 0.0 3 1.0 3 1.0 0 1 1
6 1.0 30 0.0 25 0.0 0 1 1
4 0.0 40 0.0 1 1.0 0 1 1
2 0.0 30 0.0 2 1.0 0 1 1
15 0.0 60 0.0 3 1.0 0 1 1
1 0.0 2 1.0 1 1.0 0 1 1
5 0.2 3 1.0 40 0.0 0 1 1
3 1.0 3 1.0 4 1.0 0 1 0
2 1.0 40 0.0 2 1.0 0 1 0
4 1.0 3 1.0 12 0.0 0 1 0
1 1.0 0 0.0 1 1.0 0 0 0
2 1.0 2 1.0 3 1.0 0 0 0
3 1.0 2 1.0 45 0.0 0 0 0
4 0.7 40 0.0 3 1.0 0 0 0
2 0.0 2 1.0 2 1.0 0 0 0
3 0.0 1 1.0 4 0.5 0 0 0
45 0.0 3 1.0 60 0.0 0 0 1
60 0.1 45 0.0 50 0.0 0 0 1
30 0.2 60 0.0 40 0.1 0 0 1
12 0.0 50 0.0 45 0.0 0 0 1
6 0.0 40 0.0 70 0.0 0 0 1
1 0.0 40 0.0 50 0.0 0 0 1
8 0.0 2 1.0 60 0.0 0 0 1
25 0.0 0 0.0 30 0.0 0 0 1
20 0.0 0 0.0 0 0.0 0 0 1
3 0.0 0 0.0 0 0.0 0 0 1
28 0.0 50 0.0 2 1.0 0 0 1
27 0.0 1 0.0 3 1.0 0 1 1
150 0.0 1 0.0 2 1.0 0 1 1
8 0.0 1 0.0 2 1.0 0 1 1
60 0.0 2 0.0 30 1.0 0 1 1
14 0.0 1 0.0 1 1.0 0 1 1
27 0.0 1 0.0 3 1.0 0 0 1
90 0.0 2 0.0 5 1.0 0 0 1
150 0.0 1 0.0 2 1.0 0 0 1
22 0.0 1 0.0 1 1.0 0 0 1
40 0.0 2 1.0 6 1.0 0 0 1
"""


class Tree:
    """A classification tree by Gini impurity: (feature, limit, left, right), or the class."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.root = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or (y == y[0]).all():
            return int(y.mean() >= 0.5)
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for limit in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= limit
                cost = sum(part.size * part.mean() * (1 - part.mean()) for part in (y[left], y[~left]))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, limit)
        if best is None:
            return int(y.mean() >= 0.5)
        _, f, limit = best
        left = x[:, f] <= limit
        return f, float(limit), self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def __call__(self, row: tuple) -> int:
        node = self.root
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node


@cache
def tree() -> Tree:
    table = np.array([[float(v) for v in line.split()] for line in LABELLED.split("\n") if line])
    return Tree(table[:, :-1], table[:, -1])


def _kind(name: str, attributes: str) -> tuple[int, int, bool]:
    """Whether an element by its name or attributes is of the first or the second kind above (2: hidden or for comments), and
    whether it is so only by its class or id or as a form.
    """
    sure, named = {name} - {"form"}, {name}
    if attributes:
        for what, value in ATTRIBUTE.findall(attributes):
            what, value = what.lower(), value.strip("\"'").lower()
            if what in ("hidden",) or (what == "aria-hidden" and value == "true"):
                return 2, 0, False
            if what == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    return 2, 0, False
            elif what != "hidden":
                words = re.split(r"[^a-z]+", value)
                named.update(words)
                if what == "role":
                    sure.update(words)
    if not named.isdisjoint(COMMENTS):
        return 2, 0, False
    first, second = not named.isdisjoint(ASIDE), not named.isdisjoint(BEFORE)
    return int(first), int(second), sure.isdisjoint(ASIDE) and sure.isdisjoint(BEFORE)


class Block:
    __slots__ = ("parts", "linked", "marked", "named", "within")

    def __init__(self, marked: int, named: frozenset[int], within: bool):
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.marked, self.named, self.within = marked, named, within


def blocks(page: str) -> list[tuple[str, float, int, bool]]:
    """(text, link density, marked, in an article) of every block with words, in page order."""
    out: list[tuple[str, float, int, frozenset[int], bool]] = []
    # name, first kind, second kind, in an article, elements marked by name only: of the first kind, of the second, around an article or not
    none: frozenset[int] = frozenset()
    open_: list[tuple[str, int, int, bool, frozenset[int], frozenset[int], frozenset[int]]] = []
    state = ("", 0, 0, False, none, none, none)
    holding: set[int] = set()
    numbers = links = 0
    now = Block(0, none, False)

    def fresh() -> Block:
        return Block(max(state[1], state[2]), state[4] | state[5], state[3])

    def close() -> None:
        nonlocal now
        if now.parts:
            text = " ".join(html.unescape("".join(now.parts)).split())
            if text:
                words = len(text.split(" "))
                linked = len(html.unescape(" ".join(now.linked)).split()) if now.linked else 0
                out.append((text, min(1.0, linked / words), now.marked, now.named, now.within))
        now = fresh()

    counts: dict[str, int] = {}  # of the open containers, by name
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        if at > last and not page.startswith("<!--", at):
            # no tag ends from here on, so what is left up to an open comment is text
            stop = page.find("<!--", at)
            token = page[at:] if stop < 0 else page[at:stop]
            now.parts.append(token)
            if links:
                now.linked.append(token)
            at += len(token)
            continue
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                now.parts.append(token)
                if links:
                    now.linked.append(token)
            continue
        name, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in SILENT:
            if not ends and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif name in ("script", "style", "textarea", "svg", "template", "iframe"):
                    at = n
            continue
        if name in BLOCKS:
            close()
        elif name in SPACING:
            now.parts.append(" ")
        if name == "a":
            links = max(0, links - 1) if ends else links + 1
        elif name in CONTAINERS:
            if ends:
                if counts.get(name):
                    while True:
                        closed = open_.pop()[0]
                        counts[closed] -= 1
                        if closed == name:
                            break
            elif not attributes.rstrip().endswith("/"):
                first, second, weak = _kind(name, attributes)
                counts[name] = counts.get(name, 0) + 1
                _, aside, before, within, one, two, around = state
                if name in MAIN and (weak or not first):
                    holding |= around
                    open_.append((name, aside, 0, True, one, none, around))
                elif name == "header" and within:
                    open_.append((name, aside, before, within, one, two, around))
                elif name == "body":
                    open_.append((name, 0, 0, False, none, none, none))
                elif weak and (first or second):
                    numbers += 1
                    own = frozenset((numbers,))
                    open_.append((name, aside, before, within, one | own if first else one, two if first else two | own, around | own))
                else:
                    open_.append((name, max(aside, first), max(before, second), within, one, two, around))
            state = open_[-1] if open_ else ("", 0, 0, False, none, none, none)
            if name in BLOCKS:
                links = 0 if not open_ or name in ("body", "article", "main") else links
                now = fresh()
    close()
    inside: dict[int, float] = {}
    total = 0.0
    for text, density, marked, named, _within in out:
        words = (1 - density) * (text.count(" ") + 1) * (marked < 2)
        total += words
        for k in named:
            inside[k] = inside.get(k, 0.0) + words
    ignored = holding | {k for k, words in inside.items() if 2 * words > total}
    return [(text, density, max(marked, int(bool(named - ignored))), within) for text, density, marked, named, within in out]


def main_blocks(page: str | None) -> list[str]:
    """The blocks of a page that are main text."""
    found = blocks(page or "")
    judge, none = tree(), ("", 0.0, 0, False)
    size = [len(b[0].split(" ")) for b in found]
    out = []
    for i, (text, density, marked, within) in enumerate(found):
        last, last_size = (found[i - 1], size[i - 1]) if i else (none, 0)
        following, next_size = (found[i + 1], size[i + 1]) if i + 1 < len(found) else (none, 0)
        if judge((size[i], density, last_size, last[1], next_size, following[1], marked, within)):
            out.append(text)
    return out


def extract_text(pages: DataFrame, page: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of carry, text (main blocks joined by a blank line), n_chars and n_blocks.

    References are decoded and white space inside a block is one blank.  A null or empty page, or one without main text,
    gives an empty text.  Rows are judged each on its own; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                made = [main_blocks(p) for p in some.column(len(carry)).to_pylist()]
                texts = ["\n\n".join(b) for b in made]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[: len(carry)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in made], pa.int64())],
                    names=[*carry, "text", "n_chars", "n_blocks"],
                )

    rows = pages.select(*carry, F.col(page).alias("_page"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(carry)])
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long, n_blocks long")
