"""The pipeline against the plain versions of its stages, on the smallest tables and on odd rows."""

import os

import numpy as np
import pyarrow as pa
import pytest

import brute
import corpus_pipeline
from sparktide.llm.packing import Ids
from sparktide.llm.queries import tokenizer_path
from sparktide.llm.shared import text_slices
from sparktide.llm.toxicity import Letters, toxicity_model

SF = "/root/testdata/sf0.001"


def plain(spark, docs, sf):
    """(doc_id, text) that reach the last stage; the model is the operator's own."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    kept = []
    for _, offsets, raw in text_slices(pa.array([t for _, t in rows], pa.large_string())):
        score = model.probability(model.rows(Letters(raw, offsets), len(offsets) - 1)[0])
        kept += [s < corpus_pipeline.TOXIC for s in score]
    rows = [r for r, k in zip(rows, kept, strict=True) if k]
    low = brute.groups(len(rows), brute.jaccard_links([t for _, t in rows]))
    rows = [r for k, r in enumerate(rows) if low[k] == k]
    rows = [(i, " ".join(w) if n else t) for (i, t), (_, w, n) in zip(rows, brute.substring(rows), strict=True)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    out = []
    for i, t in rows:
        n, hits, _ = brute.contamination(t, items)
        if not (hits and 20 * hits >= n):
            out.append((i, t))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain(spark, docs, SF)
    tokenizer = Ids(tokenizer_path()).tokenizer
    sizes = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want}
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(want) < docs.count()
    assert {r.doc_id: r.doc_tokens for r in got} == sizes
    assert sum(r.length for r in got) == sum(sizes.values())


def test_stages_on_odd_rows(spark, tmp_path):
    passage = " ".join(f"word{k}" for k in range(20))
    rows = [(5, passage, "en", "a", 1), (5, passage, "en", "a", 1), (9, "start " + passage + " and " + " ".join(f"t{k}" for k in range(60)), None, None, None), (3, None, "en", "a", 0), (None, "free text", "en", "a", 0), (7, "", "en", "a", 0), (8, "item " * 14, "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'s' AS score", "1 AS n_words", "2 AS removed", "3 AS kept", "4 AS id")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "item " * 13)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    got = {r.doc_id: r for r in now.collect()}
    assert sorted(got, key=str) == [3, 5, 7, 9, None] and now.count() == 5
    assert got[9].text.startswith("start and t0") and got[9].n_chars == len(got[9].text) and got[5].text == passage
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).select("doc_id").distinct().count() == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert np.isfinite(corpus_pipeline.TOXIC) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "decontamination", "packing"]
