"""Repair of the structure of conversations: faults, the cheapest edits to a legal order of roles, the repaired turns.

The edits of a conversation are one string of initials, its audit.  The cheapest audit is found row by row, for each
state that the roles so far can be in; audits share their beginnings as linked nodes, each with its ancestors at
distances 1, 2, 4, ... and a rolling hash.  Of two audits of equal cost the smaller is found by a search for the longest
common beginning over these ancestors; equal hashes are believed only after the nodes have been compared.

Equal rows are counted before anything is sorted.  All rows are then dealt by ranges of (conversation, turn, text hash),
so that a long conversation is spread over many tasks, and cut into segments of bounded size.  A conversation that lies
whole in one segment is solved there.  Of the others each segment gives the cheapest audit from each state to each
state; these summaries, without texts, are put together for each conversation, again over linked nodes.  Where a row is
the first of its text is known from a table of first turns that is sorted in between the rows, so no join by text is
needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktide.llm.shared import bounded_batches, give_back, stored

#: Rows and characters of one segment; a single text may be longer.
SEGMENT_ROWS, SEGMENT_CHARS = 2048, 1 << 20

#: Costs of the edits; a truncated row that stays adds TRUNCATED.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

#: States of the roles so far: nothing, a system turn only, ends with user, ends with assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\v\f\r"
ENDS = ".!?"
ROLES = {USER: "user", ASSISTANT: "assistant"}

MODULUS, BASE = (1 << 61) - 1, 0x1F3A5C7E9B2D4F61


class Audits:
    """Strings that grow at the end and share their beginnings: node numbers, 0 is the empty string."""

    def __init__(self):
        self.up: list[list[int]] = [[]]
        self.char, self.depth, self.hash = [""], [0], [0]

    def add(self, node: int, char: str) -> int:
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(up)
        self.char.append(char)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(char)) % MODULUS)
        return len(self.up) - 1

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def ancestor(self, node: int, depth: int) -> int:
        left = self.depth[node] - depth
        while left:
            k = left.bit_length() - 1
            node = self.up[node][k]
            left -= 1 << k
        return node

    def same(self, a: int, b: int) -> bool:
        """Equal strings of one length; equal hashes are checked character by character."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.char[a] != self.char[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, x: int, y: int) -> bool:
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.same(a, b):
            return self.depth[x] < self.depth[y]
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and not self.same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return self.char[a] < self.char[b]

    def best(self, options: list[tuple[int, int, str]]) -> tuple[int, int] | None:
        """Cost and node of the cheapest (cost, node, characters to add), the smallest string of equally cheap ones."""
        if not options:
            return None
        cost = min(o[0] for o in options)
        found = -1
        for c, node, chars in options:
            if c == cost:
                for char in chars:
                    node = self.add(node, char)
                if found < 0 or self.less(node, found):
                    found = node
        return cost, found


def with_inserts(audits: Audits, at: list) -> list:
    """The states after any inserted turns; two inserted turns lead from an open state to a closed one."""
    nothing, system, user, assistant = at
    fresh = [x for x in (nothing, system) if x]
    to_user = [(c + INSERT, n, "I") for c, n in fresh + ([assistant] if assistant else [])] + ([(*user, "")] if user else [])
    to_assistant = [(c + 2 * INSERT, n, "II") for c, n in fresh] + ([(user[0] + INSERT, user[1], "I")] if user else []) + ([(*assistant, "")] if assistant else [])
    return [nothing, system, audits.best(to_user), audits.best(to_assistant)]


def after_row(audits: Audits, at: list, initial: str, faulty: bool, truncated: bool) -> list:
    """The states after one more row; a faulty one can only be deleted."""
    nothing, system, user, assistant = at = with_inserts(audits, at)
    to = [[(x[0] + DELETE, x[1], "D")] if x else [] for x in at]
    if not faulty:
        more = TRUNCATED if truncated else 0
        if nothing and initial == "s":
            to[SYSTEM].append((nothing[0] + more, nothing[1], "K"))
        cost, char = (more, "K") if initial == "u" else (more + REROLE, "R")
        to[USER] += [(x[0] + cost, x[1], char) for x in (nothing, system, assistant) if x]
        cost, char = (more, "K") if initial == "a" else (more + REROLE, "R")
        to[ASSISTANT] += [(user[0] + cost, user[1], char)] if user else []
    return [audits.best(x) for x in to]


def ending(audits: Audits, at: list) -> tuple[int, int]:
    """The cheapest legal end: no turn at all, or an assistant's turn last."""
    at = with_inserts(audits, at)
    return audits.best([(*x, "") for x in (at[NOTHING], at[ASSISTANT]) if x])


def repaired(audit: str, state: int, rows: Iterator[tuple[str, str] | None]) -> tuple[list[tuple[str, str]], int]:
    """The turns that an audit makes of rows, and the state after them."""
    out = []
    for edit in audit:
        row = next(rows) if edit != "I" else None
        if edit == "D":
            continue
        if edit == "K":
            role, text = row
            state = SYSTEM if role.startswith("s") else USER if role.startswith("u") else ASSISTANT
        else:
            state = ASSISTANT if state == USER else USER
            role, text = ROLES[state], row[1] if row else ""
        out.append((role, text))
    return out, state


class Joined:
    """Audits made of the pieces that the segments of one conversation offer; a node's depth is its number of pieces."""

    def __init__(self):
        self.up: list[list[int]] = [[]]
        self.piece, self.came = [""], [0]

    def add(self, node: int, piece: str, came: int) -> int:
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(up)
        self.piece.append(piece)
        self.came.append(came)
        return len(self.up) - 1

    def since(self, node: int, top: int) -> list[int]:
        """Nodes from below top down to node."""
        out = []
        while node != top:
            out.append(node)
            node = self.up[node][0]
        return out[::-1]

    def less(self, x: int, y: int) -> bool:
        """x and y have as many pieces; only what follows their last common node is compared."""
        if x == y:
            return False
        a, b = x, y
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        top = self.up[a][0]
        left, right = ([self.piece[n] for n in self.since(z, top)] for z in (x, y))
        i = j = p = q = 0
        while i < len(left) and j < len(right):
            m = min(len(left[i]) - p, len(right[j]) - q)
            one, two = left[i][p : p + m], right[j][q : q + m]
            if one != two:
                return one < two
            p, q = p + m, q + m
            if p == len(left[i]):
                i, p = i + 1, 0
            if q == len(right[j]):
                j, q = j + 1, 0
        return i == len(left) and any(right[k][q if k == j else 0 :] for k in range(j, len(right)))


def cheapest_pieces(segments: list[dict]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of a conversation, and for each segment the state before it and its piece of the audit, ends included."""
    paths = Joined()
    at: list[tuple[int, int] | None] = [(0, 0), None, None, None]

    def best(options):
        options = [o for o in options if o]
        if not options:
            return None
        low = min(o[0] for o in options)
        found = None
        for cost, *made in options:
            if cost == low:
                node = paths.add(*made)
                if found is None or paths.less(node, found):
                    found = node
        return low, found

    for s in segments:
        at = [
            best([(x[0] + s["costs"][4 * q + e], x[1], s["audits"][4 * q + e], q) for q, x in enumerate(at) if x and s["costs"][4 * q + e] is not None])
            for e in STATES
        ]
    last = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
    cost, node = best([(x[0] + last[e][0], x[1], last[e][1], e) for e, x in enumerate(at) if x])
    chain = paths.since(node, 0)
    pieces = [(paths.came[n], paths.piece[n]) for n in chain]
    end = pieces.pop()[1]
    pieces[-1] = (pieces[-1][0], pieces[-1][1] + end)
    return cost, pieces


class Segment:
    """Rows of one conversation in order, with their faults."""

    def __init__(self):
        self.rows: list[tuple[str, str, bool, bool]] = []  # role, text, faulty, truncated
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None

    def full(self, most_rows: int, most_chars: int) -> bool:
        return len(self.rows) >= most_rows or self.chars >= most_chars

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        end = text.rstrip(SPACES)
        blank, duplicate = not end, bool(end) and not first
        truncated = bool(end) and first and end[-1] not in ENDS
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if self.rows and self.rows[-1][0][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.rows.append((role, "" if blank or duplicate else text, blank or duplicate, truncated))
        self.chars += 0 if blank or duplicate else len(text)

    def solve(self, audits: Audits, start: int) -> list:
        at: list = [None] * 4
        at[start] = (0, 0)
        for role, _, faulty, truncated in self.rows:
            at = after_row(audits, at, role[:1], faulty, truncated)
        return at

    def counts(self) -> dict:
        return {
            "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "distinct": self.distinct, "low": self.low, "high": self.high,
            "first_initial": self.rows[0][0][:1] if self.rows else None, "last_initial": self.rows[-1][0][:1] if self.rows else None,
        }

    def whole(self) -> dict:
        """The result of a conversation that is this segment only."""
        audits = Audits()
        cost, node = ending(audits, self.solve(audits, NOTHING))
        audit = audits.text(node)
        turns, _ = repaired(audit, NOTHING, iter([r[:2] for r in self.rows]))
        return {**self.counts(), "open": False, "cost": cost, "audit": audit, "turns": turns, "digest": hashlib.sha256(lines(turns).encode()).hexdigest()}

    def part(self) -> dict:
        """The cheapest audit from each state to each state, and the rows as they are."""
        audits = Audits()
        costs: list[int | None] = []
        texts: list[str | None] = []
        for start in STATES:
            for found in self.solve(audits, start):
                costs.append(found[0] if found else None)
                texts.append(audits.text(found[1]) if found else None)
        return {**self.counts(), "open": True, "costs": costs, "audits": texts, "turns": [None if faulty else (role, text) for role, text, faulty, _ in self.rows]}


def lines(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
NUMBERS = ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")
SEGMENT_FIELDS = [
    ("segment", pa.int64(), "long"), ("open", pa.bool_(), "boolean"), *((n, pa.int64(), "long") for n in NUMBERS),
    ("first_initial", pa.string(), "string"), ("last_initial", pa.string(), "string"),
    ("costs", pa.list_(pa.int64()), "array<long>"), ("audits", pa.list_(pa.string()), "array<string>"), ("turns", TURNS, "array<struct<role:string,text:string>>"),
    ("cost", pa.int64(), "long"), ("audit", pa.string(), "string"), ("digest", pa.string(), "string"),
]
SEGMENTS = ", ".join(f"{n} {k}" for n, _, k in SEGMENT_FIELDS)


def _as_batch(rows: list[dict], conv: pa.DataType) -> pa.RecordBatch:
    turns = [None if r["turns"] is None else [None if t is None else {"role": t[0], "text": t[1]} for t in r["turns"]] for r in rows]
    columns = [pa.array([r["conv_id"] for r in rows], conv)]
    columns += [pa.array(turns, k) if n == "turns" else pa.array([r.get(n) for r in rows], k) for n, k, _ in SEGMENT_FIELDS]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", *(n for n, _, _ in SEGMENT_FIELDS)])


def cut_segments(batches: Iterator[pa.RecordBatch], most_rows: int, most_chars: int, with_turns: bool = True) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows; the first and the last conversation of a task, and long ones, are left open."""
    number = TaskContext.get().partitionId() << 33
    none = object()
    conv, mark, inside, kind = none, None, False, None
    segment, made, out, held = Segment(), 0, [], 0

    def close(final: bool) -> None:
        """End the segment; final if the conversation ends in this task, too."""
        nonlocal segment, made, number, held
        made += 1
        row = segment.whole() if final and inside and made == 1 else segment.part()
        if not row["open"] and not with_turns:
            row["turns"] = None
        out.append({"conv_id": conv, "segment": number, **row})
        held += segment.chars + 4 * len(segment.rows)
        number, segment = number + 1, Segment()

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for c, turn, key, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if conv is none or c != conv:
                if conv is not none:
                    close(True)
                    if held > most_chars or len(out) > 1000:
                        yield _as_batch(out, kind)
                        out, held = [], 0
                    inside = True
                conv, made, mark = c, 0, None
            if copies is None:  # the next row is the first with its role and text
                mark = (turn, key)
                continue
            for k in range(copies):
                if segment.full(most_rows, most_chars):
                    close(False)
                    if held > most_chars:
                        yield _as_batch(out, kind)
                        out, held = [], 0
                segment.add(turn, role, text, k == 0 and mark == (turn, key))
    if conv is not none:
        inside = False  # it may go on in the next task
        close(True)
        yield _as_batch(out, kind)
    give_back()


SOLVED = [
    ("segment", pa.int64(), "long"), ("state", pa.int32(), "int"), ("piece", pa.string(), "string"), ("place", pa.int64(), "long"), ("first", pa.bool_(), "boolean"),
    ("gaps", pa.int64(), "long"), *((n, pa.int64(), "long") for n in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string(), "string"),
]


def put_together(table: pa.Table) -> pa.Table:
    """The pieces of the audit of one conversation, and what holds for all of it in the row of its first segment."""
    rows = sorted(table.drop_columns(["conv_id"]).to_pylist(), key=lambda r: r["segment"])
    rows = [r for r in rows if r["first_initial"] is not None] or rows[:1]
    cost, pieces = cheapest_pieces(rows)
    total = {n: sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    turns = [r for r in rows if r["low"] is not None]
    distinct = sum(r["distinct"] for r in turns) - sum(a["high"] == b["low"] for a, b in zip(turns, turns[1:], strict=False))
    total["gaps"] = turns[-1]["high"] - turns[0]["low"] + 1 - distinct if turns else 0
    out, place = [], 0
    for k, (r, (state, piece)) in enumerate(zip(rows, pieces, strict=True)):
        more = {**total, "cost": cost, "audit": "".join(p for _, p in pieces)} if k == 0 else {}
        out.append({"segment": r["segment"], "state": state, "piece": piece, "place": place, "first": k == 0, **more})
        place += len(piece) - piece.count("D")
    conv = table.column("conv_id")[:1]
    columns = [pa.chunked_array([conv.combine_chunks().take(pa.array([0] * len(out)))])]
    columns += [pa.array([r.get(n) for r in out], k) for n, k, _ in SOLVED]
    return pa.table(columns, names=["conv_id", *(n for n, _, _ in SOLVED)])


def apply_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of segments (conv_id, segment, place, state, piece, turns)."""
    for batch in batches:
        made = []
        for state, piece, turns in zip(*(batch.column(n).to_pylist() for n in ("state", "piece", "turns")), strict=True):
            done, _ = repaired(piece, state, iter([t and (t["role"], t["text"]) for t in turns]))
            made.append([{"role": r, "text": t} for r, t in done])
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv_id", "segment", "place")), pa.array(made, TURNS)], names=["conv_id", "segment", "place", "turns"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's turns; segments come sorted, and one is held at a time."""
    none = object()
    conv, hasher, begun, kind = none, None, False, None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        ids, texts = [], []
        for c, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            if conv is none or c != conv:
                if conv is not none:
                    ids.append(conv)
                    texts.append(hasher.hexdigest())
                conv, hasher, begun = c, hashlib.sha256(), False
            if turns:
                hasher.update((("\n" if begun else "") + lines([(t["role"], t["text"]) for t in turns])).encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string())], names=["conv_id", "digest"])
    if conv is not none:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([hasher.hexdigest()], pa.string())], names=["conv_id", "digest"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after a damage that the checksum of `conv_id:turn` chooses for each row.

    Of its remainder by 20, 0 drops the row (copies 0), 1 empties its text, 2 removes the signs .!? from it, 3 repeats the
    row, 4 makes its role user.  A null id, turn, role or text reads as one blank; the turn stays null.
    """
    blank: Column = F.lit(" ")
    read = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat_ws(":", *read)), F.lit(20))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS, with_turns: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Audits, one row a conversation, and the repaired turns as rows.

    Input: conv_id, turn, role, text and copies (how often the row occurs; 0 keeps the conversation without the row);
    other columns are ignored.  Rows are taken by turn, nulls first; rows of one turn by a hash of role and text, equal
    rows next to each other.  A null role or text reads as one blank; a null conv_id is a conversation.

    Audits: conv_id, gaps (turn numbers missing between the smallest and the largest; 0 without any), blank, duplicate,
    truncated (rows whose first fault is this: no character but ASCII white space, role and text seen earlier, last
    character not one of .!?), illegal (adjacent roles that do not follow each other), cost, audit, repaired_sha256 (of
    `role:text` lines joined by line feeds).  The audit holds the initials of Keep (0), Rerole to user or assistant (2),
    Delete (3; the only choice for blank and duplicate rows) and Insert an empty turn (2) whose cost, plus 1 for each
    truncated row that stays, is least, and of these the smallest in ASCII order; the roles left begin with a system turn
    or not and alternate from user to assistant, or there are none.  A role whose first letter is none of s, u and a, or
    that is empty, can only be changed or deleted.  A conversation without rows has zeros and empty texts.

    Turns: conv_id, place (from 0), role, text; without `with_turns` they are not kept, and None.  No rows give none.  The hash of a long conversation is taken segment by
    segment in one task, since SHA-256 has no other way; nothing else of a conversation passes through one task but the
    summaries of its segments.
    """
    bounded_batches(conversations.sparkSession)
    blank = F.lit(" ")
    copies = F.coalesce("copies", F.lit(1)).cast("long")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), copies.alias("copies"))
    none = F.col("copies") <= 0
    rows = rows.select("conv_id", *(F.when(~none, F.col(c)).alias(c) for c in ("turn",)), *(F.when(none, "").otherwise(F.col(c)).alias(c) for c in ("role", "text")), "copies")
    key = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)).alias("key")
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).select("conv_id", "turn", key, "role", "text", "copies")
    seen = rows.where(~none).select("conv_id", "turn", key).groupBy("conv_id", "key").agg(F.max(F.col("turn").isNull().cast("int")).alias("null"), F.min("turn").alias("turn"))
    firsts = seen.select("conv_id", F.when(F.col("null") == 0, F.col("turn")).alias("turn"), "key", *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), F.lit(None).cast("long").alias("copies"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = counted.unionByName(firsts).repartitionByRange(*order).sortWithinPartitions(*order, F.col("copies").asc_nulls_first())
    conv = conversations.schema["conv_id"]
    kinds = T.StructType([conv, *T.StructType.fromDDL(SEGMENTS).fields])
    segments = stored(dealt.mapInArrow(partial(cut_segments, most_rows=segment_rows, most_chars=segment_chars, with_turns=with_turns), kinds), "conversation-segments")

    whole, parts = segments.where("NOT open"), segments.where("open")
    kinds = T.StructType([conv, *T.StructType.fromDDL(", ".join(f"{n} {k}" for n, _, k in SOLVED)).fields])
    solved = stored(parts.drop("turns", "open", "cost", "audit", "digest").groupBy("conv_id").applyInArrow(put_together, kinds), "conversation-pieces")
    kinds = T.StructType([conv, *T.StructType.fromDDL("segment long, place long, turns array<struct<role:string,text:string>>").fields])
    made = solved.join(parts.select("segment", "turns"), "segment").select("conv_id", "segment", "place", "state", "piece", "turns").mapInArrow(apply_pieces, kinds)
    hashed = made.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(digests, T.StructType([conv, T.StructField("digest", T.StringType())]))

    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("distinct")).cast("long")
    one = whole.withColumn("gaps", gaps).select("conv_id", *numbers, "audit", F.col("digest").alias("repaired_sha256"))
    totals = solved.where("first").select(F.col("conv_id").alias("_conv"), *numbers, "audit")
    many = totals.join(hashed, F.col("_conv").eqNullSafe(F.col("conv_id"))).select("conv_id", *numbers, "audit", F.col("digest").alias("repaired_sha256"))
    if not with_turns:
        return one.unionByName(many), None
    turns = whole.select("conv_id", F.lit(0).cast("long").alias("place"), "turns").unionByName(made.select("conv_id", "place", "turns"))
    turns = turns.select("conv_id", "place", F.posexplode("turns").alias("at", "turn")).select("conv_id", (F.col("place") + F.col("at")).alias("place"), "turn.role", "turn.text")
    return one.unionByName(many), turns
