"""One query per operator, over the whole tables, and SQL computing the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.llm.contamination import contamination
from sparktide.llm.conversation_repair import damaged, repair
from sparktide.llm.embeddings import near_vectors
from sparktide.llm.html import extract_text
from sparktide.llm.labelled import remainder
from sparktide.llm.language import identify, language_model
from sparktide.llm.licenses import scan_licenses
from sparktide.llm.packing import pack
from sparktide.llm.quality import quality_model, score_quality
from sparktide.llm.repeated_bytes import repeated_bytes
from sparktide.llm.shared import bounded_batches
from sparktide.llm.shingle_join import near_duplicates
from sparktide.llm.substring import repeated_words
from sparktide.llm.toxicity import score_toxicity, toxicity_model
from sparktide.llm.vector_codes import compress_vectors


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


OP1 = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
numbers AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN lowest USING (vec_id) LEFT JOIN numbers USING (vec_id)
"""


def op2_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = repeated_words(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS seq FROM starts),
firsts AS (SELECT seq, min(doc_id) AS least FROM windows GROUP BY 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN firsts USING (seq) WHERE least < doc_id),
each AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM words)),
kept AS (
  SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) AS text, count(*) AS n
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words LEFT JOIN kept k USING (doc_id)
"""


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = score_quality(docs, quality_model(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = scan_licenses(table(spark, sf, "documents"))
    first = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), F.size(m["differences"]).cast("string")))
    return found.select("doc_id", "n_candidates", F.size("matches").cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"), F.array_join(first, ",").alias("matches"))


def op8_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP6 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i : i + 12], ' ') AS seq
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS seq
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, size, i, item FROM runs JOIN windows USING (size, seq)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY 1),
who AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.list, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits h USING (doc_id) LEFT JOIN who o USING (doc_id)
"""


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), tokenizer_path())


def op10_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c / CAST(x.n + y.n - c AS DOUBLE) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1),
classes AS (
  SELECT w, min(doc_id) AS class_id, count(*) AS copies FROM words WHERE len(w) > 0 GROUP BY 1)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(copies, 1) AS BIGINT) AS copies,
       CAST((SELECT count(*) FROM links WHERE links.a = d.doc_id) AS BIGINT) AS n_links, component_id, component_id = d.doc_id AS kept
FROM words d LEFT JOIN classes USING (w) JOIN lowest l ON l.doc_id = d.doc_id
"""


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair(damaged(table(spark, sf, "conversations")), with_turns=False)[0]


def _state(c: str, a: str, r: str, when: str) -> str:
    return f"CASE WHEN {when} THEN {{'c': {c}, 'a': {a}, 'r': {r}}} END"


def _after(state: str, cost: str, initial: str, line: str | None, when: str = "TRUE") -> str:
    """A state after one more edit; an edit of an unreachable state, or one that may not be, is null."""
    turns = f"list_append({state}.r, {line})" if line else f"{state}.r"
    return _state(f"{state}.c + {cost}", f"{state}.a || '{initial}'", turns, f"{state} IS NOT NULL AND {when}")


def _repair_sql() -> str:
    """One row of a conversation after the other, keeping the least (cost, audit) of each state of the roles so far."""
    user, assistant = "'user:'", "'assistant:'"
    insert = lambda s, line: _after(s, "2", "I", line)
    twice = lambda s: _state(f"{s}.c + 4", f"{s}.a || 'II'", f"list_concat({s}.r, [{user}, {assistant}])", f"{s} IS NOT NULL")
    to_user = f"list_min([u, {insert('n', user)}, {insert('s', user)}, {insert('a', user)}])"
    to_assistant = f"list_min([a, {insert('u', assistant)}, {twice('n')}, {twice('s')}])"
    keep = lambda s, initial: _after(s, "late", "K", "role || ':' || text", f"NOT faulty AND role[1] = '{initial}'")
    turn = lambda s, role: _after(s, "late + 2", "R", f"'{role}:' || text", "NOT faulty")
    delete = lambda s: _after(s, "3", "D", None)
    new = {
        "n": [delete("n")],
        "s": [delete("s"), keep("n", "s")],
        "u": [delete("u2"), *(f(x, w) for x in ("n", "s", "a2") for f, w in ((keep, "u"), (turn, "user")))],
        "a": [delete("a2"), keep("u2", "a"), turn("u2", "assistant")],
    }
    bits = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
sums AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda z: CAST(ord(z) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda x, k: {bits})), 4294967295) % 20 AS kind FROM marked),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM sums),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) AS i,
         rtrim(text, e' \t\n\x0b\x0c\r') AS body FROM hurt),
seen AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
rows AS MATERIALIZED (
  SELECT *, blank OR again AS faulty, CAST(NOT blank AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS BIGINT) AS late FROM seen),
steps AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS n,
         CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS s, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS u,
         CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS a FROM conversations
  UNION ALL
  SELECT conv_id, i, {", ".join(f"list_min([{', '.join(x)}]) AS {k}" for k, x in new.items())}
  FROM (SELECT t.conv_id, r.i, n, s, {to_user} AS u2, {to_assistant} AS a2, r.role, r.text, r.faulty, r.late
        FROM steps t JOIN rows r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1)),
final AS (
  SELECT conv_id, list_min([n, {to_assistant}]) AS f FROM steps t
  WHERE i = (SELECT count(*) FROM rows r WHERE r.conv_id IS NOT DISTINCT FROM t.conv_id)),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, sum(CAST(blank AS INT)) AS blank, sum(CAST(again AS INT)) AS duplicate, sum(late) AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT f.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
       f.c AS cost, f.a AS audit, sha256(array_to_string(f.r, chr(10))) AS repaired_sha256
FROM final f LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id
"""


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    found = compress_vectors(table(spark, sf, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same for vectors of one length that is a multiple of `parts`."""
    steps = [f"""
ints AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS w FROM ints, range({parts}) t(p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, w FROM parts QUALIFY k < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, p, any_value(a.w) AS w, min({{'d': list_sum(list_transform(list_zip(a.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'k': k}}) AS best
  FROM parts a JOIN book{r} b USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.w, b.w) AS w FROM book{r} b LEFT JOIN (
    SELECT p, k, list(x ORDER BY i) AS w FROM (
      SELECT p, k, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
      FROM (SELECT p, best.k AS k, unnest(w) AS x, unnest(range(len(w))) AS i FROM near{r}) GROUP BY p, k, i) GROUP BY p, k) m
  ON m.p = b.p AND m.k = b.k)""")
    return "WITH " + ",".join(steps) + f""",
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, k)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN ints USING (vec_id)
"""


def op13_repeated_bytes(spark: SparkSession, sf: str) -> DataFrame:
    found = repeated_bytes(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13 = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS i FROM texts WHERE len(h) >= 200),
windows AS (SELECT doc_id, i, md5(array_slice(h, 2 * i + 1, 2 * i + 200)) AS w FROM starts),
late AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, TRUE) AS fresh FROM late),
numbered AS (SELECT doc_id, i, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs),
gone AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY 1, 2),
between AS (
  SELECT doc_id, run, array_slice(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) + 1, 2 * a) AS piece, b - a AS n, b FROM gone JOIN texts USING (doc_id)),
left_over AS (SELECT doc_id, string_agg(piece, '' ORDER BY run) AS kept, max(b) AS b, sum(n) AS n, count(*) AS runs FROM between GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || array_slice(h, 2 * coalesce(b, 0) + 1, len(h)))) AS kept_sha256
FROM texts LEFT JOIN left_over USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": op1_near_vectors,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_html_text": op5_html_text,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_repeated_bytes": op13_repeated_bytes,
}

SQL: dict[str, str] = {
    "op1_near_vectors": OP1,
    "op2_substring_dedup": OP2,
    "op6_decontamination": OP6,
    "op10_ngram_join": OP10,
    "op11_conversation_repair": _repair_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_repeated_bytes": OP13,
}
