"""Repaired conversations against an enumeration of all edits."""

import hashlib
import random
import re
import zlib

import pytest

from sparktide.llm import conversation_repair
from sparktide.llm.conversation_repair import Audits, damaged, repair

SPACES = " \t\n\v\f\r"
KIND = "conv_id long, turn long, role string, text string, copies long, cost string"


def faults(rows):
    """[(role, text, first fault)] of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, turns) by trying all edits no dearer than deleting everything."""
    best = (3 * len(rows) + 1, "", [])

    def go(i, cost, audit, turns):
        nonlocal best
        initials = "".join(t[0][:1] or "-" for t in turns)
        if cost > min(best[0], 3 * len(rows)) or not re.fullmatch("s?(ua)*u?", initials):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit, turns))
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", [*turns, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", turns)
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                go(i + 1, cost + late, audit + "K", [*turns, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + late + 2, audit + "R", [*turns, (new, text)])

    go(0, 0, "", [])
    return best


def plain(rows):
    """All columns of one conversation from its (turn, role, text) rows in order."""
    found = faults([r[1:] for r in rows])
    cost, audit, turns = cheapest(found)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in turns)
    return gaps, *(sum(f[2] == k for f in found) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def key(row):
    """The stated order: turn with nulls first, then a hash of role and text."""
    turn, role, text = row
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest())


def result(r):
    return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256


def conversations(n, seed=3):
    rnd = random.Random(seed)
    out = {}
    for c in range(n):
        turns = range(rnd.randint(1, 5))
        out[c] = [(rnd.choice([t, t, t, 7, None]), rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["Yes.", "No", "So?", " ", "é!"])) for t in turns]
    return out


@pytest.mark.parametrize("most,parts", [(2048, 4), (2, 4), (1, 7)])
def test_against_all_edits(spark, most, parts):
    talks = conversations(60)
    rows = [(c, *r, 1, "x") for c, t in talks.items() for r in t]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        audits, turns = repair(spark.createDataFrame(rows, KIND).repartition(3), segment_rows=most)
        got = {r.conv_id: r for r in audits.collect()}
        lines = {}
        for r in turns.orderBy("conv_id", "place").collect():
            lines.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(talks)
    for c, talk in talks.items():
        want = plain(sorted(talk, key=key))
        assert result(got[c]) == want, talk
        made = lines.get(c, [])
        assert [p for p, _ in made] == list(range(len(made)))
        assert hashlib.sha256("\n".join(x for _, x in made).encode()).hexdigest() == want[-1]


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "Be brief."), ("user", "Why? Tell me."), ("assistant", "No.")])] + [(None, None, None, None), (7, None, None, "a.b")]
    got = sorted(map(str, (tuple(r) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())))
    want = []
    for c, t, role, text in rows:
        role, text, copies = " " if role is None else role, " " if text is None else text, 1
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            role, text, copies = "", "", 0
        elif kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 3:
            copies = 2
        elif kind == 4:
            role = "user"
        want.append((c, t, role, text, copies))
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("most", [2048, 1])
def test_odd_rows(spark, most):
    long = "word " * 30000 + "end."
    rows = [
        (1, 0, "user", None, 1, ""), (2, 0, "user", "gone.", 0, ""), (None, 1, None, "Text.", 1, ""), (3, 0, "user", long, 1, ""), (3, 1, "assistant", long, 1, ""),
        (4, 0, "user", "Same.", 300, ""), (4, 9, "assistant", "Same.", None, ""), (5, 2**62, "user", "Hi.", 1, ""), (5, 2**62 + 3, "assistant", "Hi.", 1, ""),
    ]
    got = {r.conv_id: r for r in repair(spark.createDataFrame(rows, KIND), segment_rows=most)[0].collect()}
    assert result(got[1]) == plain([(0, "user", " ")])
    assert result(got[2]) == plain([]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result(got[None])[:7] == (0, 0, 0, 0, 0, 3, "D")
    assert result(got[3]) == plain([(0, "user", long), (1, "assistant", long)])
    assert result(got[4])[:7] == (8, 0, 299, 0, 299, 897, "K" + "D" * 299 + "K")
    assert got[5].gaps == 2 and got[5].audit == "KK"
    audits, turns = repair(spark.createDataFrame(rows, KIND).limit(0))
    assert audits.collect() == [] and turns.collect() == []
    assert audits.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert turns.columns == ["conv_id", "place", "role", "text"]


def test_one_long_conversation(spark):
    rnd = random.Random(8)
    rows = [(1, t, rnd.choice(["user", "assistant", "tool"]), f"{rnd.randint(0, 900)}{rnd.choice('.,')}", 1, "") for t in range(1500)]
    whole = repair(spark.createDataFrame(rows, KIND).coalesce(1))[0].collect()
    cut = repair(spark.createDataFrame(rows, KIND), segment_rows=50)[0].collect()
    lone, none = repair(spark.createDataFrame(rows, KIND).union(spark.createDataFrame([(0, 0, "user", "Hi.", 1, ""), (2, 0, "user", "Hi.", 1, "")], KIND)).coalesce(1), with_turns=False)
    assert none is None and sorted((r.conv_id, r.audit[:2]) for r in lone.where("conv_id <> 1").collect()) == [(0, "KI"), (2, "KI")]
    assert whole == cut and whole[0].audit.count("D") < 1500


def test_linked_audits():
    rnd = random.Random(1)
    audits, nodes = Audits(), [0]
    for _ in range(300):
        nodes.append(audits.add(rnd.choice(nodes[-20:]), rnd.choice("DDDIKR")))
    for _ in range(2000):
        a, b = rnd.choice(nodes), rnd.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(conversation_repair, "MODULUS", 3)
    test_linked_audits()
