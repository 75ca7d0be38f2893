"""Contamination, licences, pages, packing."""

import random
import time
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest

import brute
from sparktide.llm import contamination as decontamination
from sparktide.llm import packing
from sparktide.llm.contamination import contamination
from sparktide.llm.html import blocks, extract_text, main_blocks, tree
from sparktide.llm.licenses import NOTICES, WORD, Scanner, align, scan_licenses
from sparktide.llm.packing import Ids, pack
from sparktide.llm.queries import tokenizer_path

rnd = random.Random(8)
WORDS = ["Alpha", "beta", "GAMMA", "été", "x1", "42", "zeta", "eta"]


def text(n):
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))


@pytest.mark.parametrize("limit", [8_000_000, 150])
def test_contamination_against_plain(spark, limit):
    items = [(i, text(n)) for i, n in enumerate([30, 20, 13, 12, 3, 1, 0])] + [(100, None), (None, text(5)), (11, "!!"), (12, text(14))]
    rows = [(i, text(rnd.randint(0, 80)) + (rnd.choice(items[:5])[1] or "") + text(rnd.randint(0, 200))) for i in range(25)]
    rows += [(50, None), (51, ""), (52, "..."), (53, items[4][1]), (53, items[4][1]), (None, items[3][1].upper())]
    docs = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(contamination(docs, bench, item_bytes=limit).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    assert len(got) == len(want) and any(r.contaminated for r in got) and not all(r.contaminated for r in got)
    for r, (i, t) in zip(got, want, strict=True):
        n, hits, found = brute.contamination(t, [x for x in items if x[0] is not None])
        assert (r.n_words, r.n_hit, r["items"]) == (n, hits, found), i
        assert r.contaminated == (hits > 0 and 20 * hits >= n)
        assert sum(len(brute.normal_words(t[s.start : s.end])) for s in r.spans) == hits


def test_contamination_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in contamination(docs, bench).collect()] == [(2, 0, False)]
    assert contamination(docs.limit(0), docs.selectExpr("doc_id AS item_id", "text")).count() == 0
    assert contamination(docs.withColumn("n_chars", docs.doc_id), bench, carry=("n_chars",)).columns[:3] == ["doc_id", "text", "n_chars"]


def test_long_text_is_scanned_whole():
    item = " ".join(f"k{i}" for i in range(13))
    find = decontamination.Scanner([("7", item)], 13)
    n, hit, items = find(decontamination.normal("a b " * 150_000 + item.upper()))
    assert (n, len(hit), items) == (300_013, 13, {"7"}) and hit[0] == 300_000


def test_licence_wording():
    scan = Scanner(NOTICES)
    for name, notice in NOTICES:
        n, found = scan(f"Some words here\n{notice}\nand more of them")
        assert n >= 1 and [f["license"] for f in found] == [name] and not found[0]["differences"], notice
    assert scan("It is licensed under nothing that we know.")[1] == []
    assert [m["license"] for m in scan("THIS WORK IS LICENSED under GNU general public license version 3!")[1]] == ["GPL-3.0"]
    assert scan("Licensed under CC BY-XX 4.0.")[1] == [] and scan("Released under the WIT License.")[1] == []
    assert scan(None) == (0, []) and scan("") == (0, [])


def edits(a, b):
    """Fewest words left out or put in to turn a into some run of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + 2 * (x != y)))
        row = new
    return min(row)


def test_alignment_against_plain():
    for _ in range(200):
        a, b = [rnd.choice("abc") for _ in range(rnd.randint(1, 7))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        first, last, said = align(a, b)
        assert len(said) == edits(a, b)
        kept = b[first : last + 1]
        assert len(kept) - sum(d[0] == "+" for d in said) + sum(d[0] == "-" for d in said) == len(a)


def test_winner_is_the_nearest_wording():
    scan = Scanner(NOTICES)
    for _ in range(60):
        name, notice = rnd.choice(NOTICES)
        words = notice.split()
        k = rnd.randrange(len(words))
        changed = " ".join([*words[:k], "indeed", *words[k:]])
        best = min(edits(WORD.findall(n.lower()), WORD.findall(changed.lower())) for _, n in NOTICES)
        for m in scan(changed)[1]:
            assert m["license"] == name and len(m["differences"]) <= best + 1


def wrapped(notice, width, before):
    return "\n".join(textwrap.wrap(notice, width, initial_indent=before, subsequent_indent=before, break_long_words=False, break_on_hyphens=False))


def test_wrapped_licences():
    scan = Scanner(NOTICES)
    for name, notice in NOTICES:
        for width, before in ((40, ""), (72, " * "), (80, "# ")):
            text = f"{before}Copyright 2020 Some Body\n{before}\n{wrapped(notice, width, before)}\n{before}\n{before}More words.\n"
            found = scan(text)[1]
            assert [(f["license"], f["differences"]) for f in found] == [(name, [])], text
            assert WORD.findall(text[found[0]["start"] : found[0]["end"]].lower()) == WORD.findall(notice.lower())


def test_several_licences():
    scan = Scanner(NOTICES)

    def names(text):
        return [m["license"] for m in scan(text)[1]]

    assert names("It is licensed under the MIT License or the Apache License, Version 2.0, at your option.") == ["MIT", "Apache-2.0"]
    assert names("Available under the\nGNU General Public License, version 2,\nor the BSD 3-Clause License and the ISC License.") == ["GPL-2.0", "BSD-3-Clause", "ISC"]
    whole = {name: notice for name, notice in NOTICES if len(notice) > 500 and not notice.endswith(("distribution.", "conditions:", "permission."))}
    assert set(whole) == {"MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD", "ISC", "Apache-2.0"}
    for one, first in whole.items():
        for two, second in whole.items():
            assert names(f"Released under the ISC License. {first}\n\n{second}\nReleased under the MIT License.") == ["ISC", one, two, "MIT"]
    assert names("under a Creative Commons Attribution-NoDerivatives 4.0 International License") == []
    listed = whole["BSD-3-Clause"].replace("Redistributions of", "\n\n1. Redistributions of").replace("Redistributions in", "\n\n2. Redistributions in").replace("Neither", "\n\n3. Neither")
    assert names(listed.replace("the copyright holder nor", "Some Body nor")) == ["BSD-3-Clause"]


def test_licence_rows(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (None, None, "x"), (3, "", "x"), (4, "word " * 100_000 + "\nLicensed under CC BY-NC 4.0.", "x")], "doc_id long, text string, licenses string")
    got = sorted(scan_licenses(docs).collect(), key=lambda r: r.doc_id or 0)
    assert [r.licenses for r in got] == [[], ["MIT"], ["MIT"], [], ["CC-BY-NC-4.0"]]
    assert got[4].matches[0].start == 500_001
    assert scan_licenses(docs.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="top"><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href='/b>c'>News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<main><article id="story"><header><h1>The &lt;real&gt; title</h1></header><p>First <b>bold</b>word&nbsp;and   more
text of the <a href="x">first</a> paragraph.<div class="ad">Buy now</div><p>Second<br>line &amp; end&hellip;</p><form><label>Mail</label></form>
<ul><li>one item of a list</li><li>another</li></ul><script>var a = "</p><p>no</p>"</script><!-- <p>hidden</p> --></article>
<section class="comments"><article><p>Nice post, thanks a lot for it.</p></article></section></main>
<aside><p>Related things to read on.</p></aside><footer><p>&copy; 2024 Site</p></footer></body></html>"""


def test_page():
    assert main_blocks(PAGE) == ["The <real> title", "First boldword and more text of the first paragraph.", "Second line & end…", "one item of a list", "another"]
    assert [b[1] for b in blocks("<p><a>x</a></p><p>x y</p>")] == [1.0, 0.0]


def test_page_without_article():
    page = "<div class=menu><a href=/>Home</a> <a>All</a></div><div><p>" + "many words of a long text that is the body " * 3 + "</p><p>" + "and more words of it in the next block " * 3 + "</p></div><div id=footer>end</div>"
    assert len(main_blocks(page)) == 2


@pytest.mark.parametrize("around", ['<article class="long-form">%s</article>', '<div class="search-result">%s</div>', '<div id="social-post">%s</div>', '<form action="/x"><div>%s</div></form>', '<form><main class="sidebar-left">%s</main></form>', '<div class="legal">%s</div>'])
def test_names_do_not_lose_the_main_text(around):
    text = ["many words of a long text that is the body " * 4, "a short line of it", "and more words of it in the next block " * 4]
    menu = '<div class="menu"><a href="/">Home</a> <a href="/all">All of it</a></div>'
    comments = '<section class="comments"><article class="comment"><p>' + "words of a reader who has a lot to say on it " * 20 + "</p></article></section>"
    page = f"<body>{menu}{around % ''.join(f'<p>{t}</p>' for t in text)}%s<footer>the end</footer></body>"
    assert main_blocks(page % "") == [t.strip() for t in text]
    assert main_blocks(page % comments) == [t.strip() for t in text]


def test_small_marked_parts_stay_out():
    page = f'<article><p>{"many words of a text " * 20}</p><div class="share"><p>Send it to all the people that you know well</p></div><div hidden><p>{"unseen words " * 90}</p></div></article>'
    assert main_blocks(page) == [("many words of a text " * 20).strip()]


def test_broken_pages():
    for page in (None, "", "<", "<p", "</div></p>", "<p>a < b", "<script>never closed", "&am &amp x", "<a href=\"x>y</a>", "<p>" * 3000):
        assert isinstance(main_blocks(page), list)
    assert main_blocks("<article><p>a &lt b<p>c</article>") == ["a < b", "c"]


def test_tree_agrees_with_its_table():
    assert tree()((70, 0.0, 12, 0.0, 85, 0.0, 0, 1)) == 1 and tree()((40, 0.0, 1, 1.0, 12, 0.0, 1, 0)) == 0


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = extract_text(pages).collect()
    assert [r.n_chars for r in got] == [len(got[0].text)] * 2 + [0, 0] and [r.text for r in got[2:]] == ["", ""]
    assert extract_text(pages.limit(0)).count() == 0


SIGNS = list("ab's tlre v \n\t  1²!_é'　\x85\x1c漢") + ["'ll", "'s", " 's", "  "]


def test_ids_against_the_library(monkeypatch):
    ids = Ids(tokenizer_path())
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["", None, "a<|endoftext|>b"]
    want = [ids.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]

    def found(ts):
        return [x.tolist() for _, flat, size in ids.rows(pa.array(ts, pa.string())) for x in np.split(flat, np.cumsum(size)[:-1])]

    assert found(texts[:-1]) == want[:-1] and found(texts[-2:]) == want[-2:]
    monkeypatch.setattr(packing, "SLICE", 700)
    monkeypatch.setattr(packing, "CACHED_PIECES", 60)
    long = " ".join("words in a row" for _ in range(900))
    assert found([long, "x"]) == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in (long, "x")]


@pytest.mark.parametrize("length", [1024, 7])
def test_pieces_round_trip(spark, length):
    texts = [text(rnd.randint(0, 120)) for _ in range(50)] + ["", None, "x", "x"]
    docs = spark.createDataFrame([(i if i < 52 else 52, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(5)
    got = pack(docs, tokenizer_path(), length=length, keep_ids=True).collect()
    tokenizer = Ids(tokenizer_path()).tokenizer
    sequences: dict = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, pieces in sequences.items():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
        assert sum(p.length for p in pieces) == length or k == len(sequences) - 1
    whole: dict = {}
    for r in sorted((p for s in sequences.values() for p in s), key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            whole.setdefault(r.doc_id, []).append(b"")
        whole[r.doc_id][-1] += r["ids"]
    for i, t in enumerate(texts):
        want = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert want in whole[min(i, 52)]
    assert sum(map(len, whole.values())) == len(texts)


def test_packing_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    assert pack(docs.limit(0), tokenizer_path()).count() == 0
    assert [(r.doc_id, r.start, r.length) for r in pack(docs, tokenizer_path()).collect()] == [(None, 0, 2)]


def test_words_of_the_contract():
    assert brute.normal_words("Été A_b-9!") == ["Été", "a", "b", "9"]
    assert decontamination.normal("Été A_b-9!") == " Été a b 9 " and re.findall(decontamination.WORD, b"a_b") == [b"a", b"b"]


def test_no_text_of_its_own_is_lost():
    """Blocks without links and marks stay, in an article whatever their size, elsewhere from 20 words on."""
    for own in (8, 20, 27, 60, 150, 300):
        for before in ((0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0), (30, 0.0), (2, 1.0), (40, 1.0), (10, 0.5)):
            for after in ((0, 0.0), (1, 0.0), (2, 0.0), (50, 0.0), (30, 0.5), (1, 1.0), (3, 1.0), (12, 1.0)):
                for within in (0, 1):
                    if own >= 20 or within:
                        assert tree()((own, 0.0, *before, *after, 0, within)), (own, before, after, within)
    words = " ".join(["word"] * 27)
    page = f"<article><h1>Sources</h1><p>{words}</p><p><a href=x>Read this page</a></p><p>{words} end</p></article>"
    assert main_blocks(page)[:2] == ["Sources", words] and main_blocks(page)[-1] == f"{words} end"


@pytest.mark.parametrize("page", ['<a b="' * 170_000, "<a " * 340_000, "<div><span>" * 45_000 + "x" + "</span></div>" * 45_000, "<div>" * 200_000])
def test_large_broken_pages_take_linear_time(page):
    start = time.process_time()
    main_blocks(page)
    assert time.process_time() - start < 6
