"""Classifiers: held-out accuracy, rows that may not be learned from, odd texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparktide.llm import language, quality, toxicity
from sparktide.llm.labelled import remainder, sample_by_label
from sparktide.llm.shared import text_slices

rnd = random.Random(6)
BAD = ["grumbleface", "nitwitted", "blockhead", "scoundrel"]
PARTS = "ka lo mi ren tu shi ba do fe nor".split()


def word():
    return "".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 4)))


def clean_text(n=60):
    return " ".join(word() for _ in range(n)) + "."


def toxic_text(n=60, change=lambda w: w):
    w = clean_text(n).split()
    for _ in range(2):
        w.insert(rnd.randrange(len(w)), change(rnd.choice(BAD)))
    return " ".join(w)


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.train([(clean_text(), 0) for _ in range(150)] + [(toxic_text(), 1) for _ in range(80)])


def values(model, texts):
    out = []
    for _, offsets, raw in text_slices(pa.array(texts, pa.large_string())):
        letters = toxicity.Letters(raw, offsets)
        out.append(model.probability(model.rows(letters, len(offsets) - 1)[0]))
    return np.concatenate(out)


@pytest.mark.parametrize("change", [lambda w: w, str.upper, " ".join, ".".join, lambda w: w[:4] + "-" + w[4:], lambda w: w[:3] + w[2] + w[3:], lambda w: w.replace("o", "0")])
def test_toxicity_finds_hidden_words(toxic_model, change):
    bad = values(toxic_model, [toxic_text(change=change) for _ in range(60)])
    good = values(toxic_model, [clean_text() for _ in range(60)])
    assert (bad >= 0.7).mean() > 0.9 and (good < 0.7).mean() > 0.95


SHORT = ["scum", "idiot", "moron", "clown", "loser", "stupid"]


def judged(model, texts):
    """Whether texts are toxic, as score_toxicity decides."""
    out = []
    for _, offsets, raw in text_slices(pa.array(texts, pa.large_string())):
        letters = toxicity.Letters(raw, offsets)
        out.append(model.probability(model.rows(letters, len(offsets) - 1)[0]) >= 0.7)
    return np.concatenate(out)


@pytest.fixture(scope="module")
def short_model():
    return toxicity.train([(clean_text(), 0) for _ in range(150)] + [(f"{clean_text(10)} {bad} {clean_text(10)}", 1) for bad in SHORT for _ in range(20)])


def test_letters_put_into_short_insults(short_model):
    put = [w[:at] + x + w[at:] for w in SHORT for at in range(1, len(w)) for x in "xuemz"]
    assert judged(short_model, [f"{clean_text()} {w} {clean_text()}" for w in put]).mean() > 0.95
    assert judged(short_model, [clean_text() for _ in range(100)]).mean() < 0.05


def test_one_letter_less_is_the_word_without_it(short_model):
    def of(words):
        raw = " ".join(words).encode()
        return toxicity.Letters(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))

    value, less = short_model.both(of(["scxum", "idixot", "scum"]))
    assert np.allclose(value, short_model.words(of(["scxum", "idixot", "scum"])))
    assert less[0] >= short_model.words(of(["scum"]))[0] - 1e-9 and less[1] >= short_model.words(of(["idiot"]))[0] - 1e-9 and less[2] == -np.inf


def test_insults_of_two_and_three_letters():
    def texts(words):
        return [f"{clean_text(10)} {w} {clean_text(10)}" for w in words for _ in range(30)]

    model = toxicity.train([(clean_text(), 0) for _ in range(150)] + [(t, 1) for t in texts(["oaf", "git", "zy"])])
    assert judged(model, texts(["oaf", "GIT", "zy", "o-a-f"])).mean() > 0.9
    assert judged(model, texts(["oak", "gi", "zygit"])).mean() < 0.4 and judged(model, [clean_text() for _ in range(100)]).mean() < 0.05


def test_training_bounds_are_parameters():
    examples = [(clean_text(), 0) for _ in range(60)] + [(toxic_text(), 1) for _ in range(60)]
    few = toxicity.train(examples, landmarks=6, most_toxic=2, most_clean=50, toxic_words=1, clean_words=1, every=100)
    assert 0 < len(few.weights) < len(toxicity.train(examples).weights)


def plain_value(model, text):
    """The strongest word by the kernel sum, letter by letter."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    best = model.bias
    for w in low.split():
        raw = bytes(b for b in w.encode() if 97 <= b <= 122 or b >= 128)
        total = 0.0
        for p, weight in zip(toxicity.PATTERNS, toxicity.WEIGHTS, strict=True):
            for i in range(len(raw) - p[-1]):
                key = np.frombuffer(bytes(raw[i + k] for k in p), "<u4")[0]
                at = np.searchsorted(model.lookup.keys, key)
                if at < len(model.lookup.keys) and model.lookup.keys[at] == key:
                    total += weight * model.weights[at]
        if raw:
            best = max(best, total / toxicity.lengths(np.array([len(raw)]))[0] + model.bias)
    return best


def test_toxicity_against_plain(toxic_model):
    texts = [toxic_text(20), clean_text(20), "", "!!", "xx yy", "élan grumbleface, nitwitted!"]
    want = toxic_model.probability(np.array([plain_value(toxic_model, t) for t in texts]))
    assert np.allclose(values(toxic_model, texts), want, atol=1e-9)


def test_words_of_single_letters_are_joined():
    raw = np.frombuffer(b"a b-c d ab e", np.uint8)
    letters = toxicity.Letters(raw, np.array([0, 5, len(raw)]))
    assert [letters.text(w) for w in range(len(letters.row))] == [b"a", b"bc", b"d", b"ab", b"e"]
    letters = toxicity.Letters(np.frombuffer(b"x i d i o t y0u", np.uint8), np.array([0, 15]))
    assert [letters.text(w) for w in range(len(letters.row))] == [b"xidiot", b"you"]


def table(spark, rows, kind="toxic int"):
    return spark.createDataFrame(rows, f"doc_id long, text string, {kind}, other int")


def test_toxicity_query_columns_and_odd_rows(spark, toxic_model):
    docs = table(spark, [(1, None, 0, 1), (2, "", 0, 1), (2, "", 0, 1), (None, "long " * 200_000, 0, 1), (4, BAD[0], 1, 1)])
    got = toxicity.score_toxicity(docs, toxic_model).collect()
    assert [r.score >= 0.7 for r in got] == [False, False, False, False, True] and all(0 <= r.score <= 1 for r in got)
    assert [r.evidence for r in got] == [None, None, None, "long", BAD[0]]
    assert toxicity.score_toxicity(docs.limit(0), toxic_model).count() == 0
    alone = toxicity.toxicity_model(docs, docs.where("toxic = 0").select("doc_id", "toxic"))
    assert all(r.score < 0.7 for r in toxicity.score_toxicity(docs, alone).collect())
    none = toxicity.toxicity_model(docs.limit(0), docs.limit(0))
    assert toxicity.score_toxicity(docs, none).count() == 5


def test_samples_are_bounded_and_keep_out_the_held_out(spark):
    docs = table(spark, [(i, f"text {i % 40}", i % 2, 0) for i in range(200)] + [(None, "x", 1, 0), (300, None, 1, 0), (301, "y" * 50, 1, 0)])
    got = sample_by_label(docs.where(remainder("doc_id", 3) != 1).select("doc_id", "text"), docs.select("doc_id", "toxic"), "toxic", [0, 1], 5, 20)
    assert len(got) == 10 and [sum(y == v for _, y in got) for v in (0, 1)] == [5, 5]
    allowed = {f"text {i % 40}" for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {t for t, _ in got} <= allowed
    again = sample_by_label(docs.orderBy("text").where(remainder("doc_id", 3) != 1).select("doc_id", "text"), docs.select("doc_id", "toxic"), "toxic", [0, 1], 5, 20)
    assert again == got


def junk_text():
    return rnd.choice([lambda: " ".join(w + "$$$" for w in clean_text().split()), lambda: clean_text().upper().replace(" ", "!! "), lambda: " ".join([word()] * 40)])()


def test_quality_on_texts_not_seen(spark):
    model = quality.train([(clean_text(), 1) for _ in range(200)] + [(junk_text(), 0) for _ in range(100)])
    rows = [(i, clean_text() if i % 2 else junk_text(), i % 2, 0) for i in range(120)]
    got = quality.score_quality(table(spark, rows), model).collect()
    assert np.mean([(r.score >= 0.3) == (r.toxic == 1) for r in got]) > 0.95
    odd = table(spark, [(1, None, 0, 0), (2, "", 0, 0), (3, "a", 0, 0), (None, "ab " * 300_000, 0, 0)])
    assert all(0 <= r.score <= 1 for r in quality.score_quality(odd, model).collect())
    assert quality.score_quality(odd.limit(0), model).count() == 0


def test_quality_is_the_same_for_a_row_wherever_it_stands():
    model = quality.train([(clean_text(), 1) for _ in range(30)] + [(junk_text(), 0) for _ in range(30)])
    texts = ["é" * 3, "", clean_text(5), "a b a b", junk_text()]

    def scores(ts):
        return np.concatenate([model.rows(raw, offsets) for _, offsets, raw in text_slices(pa.array(ts, pa.large_string()))])

    assert np.allclose(scores(texts), np.concatenate([scores([t]) for t in texts]), atol=1e-12)


def test_quality_without_labels(spark):
    docs = table(spark, [(1, "a b", 0, 0)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert 0 <= quality.score_quality(docs, quality.quality_model(docs, labels)).first().score <= 1


FORMS = {"aa": ["kala", "mika", "tasa"], "bb": ["xylo", "qyth", "zoxy"], "cc": ["brun", "grud", "drub"]}


def in_language(lang, n=30):
    return " ".join(rnd.choice(FORMS[lang]) + rnd.choice(["", "en", "o"]) for _ in range(n))


def test_language_on_texts_not_seen(spark):
    rows = [(i, in_language(lang), lang, 0) for i, lang in enumerate(rnd.choices(list(FORMS), k=200))]
    docs = table(spark, rows, "lang string")
    model = language.language_model(docs)
    assert model.languages == sorted(FORMS)
    got = language.identify(docs.select("doc_id", "text"), model).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.99 and all(0 <= r.score <= 1 for r in got)
    odd = language.identify(spark.createDataFrame([(1, None), (2, ""), (3, "12 $$"), (4, "é"), (None, "kala " * 200_000)], "doc_id long, text string"), model).collect()
    assert [r.lang_pred == "und" for r in odd] == [True, True, True, False, False] and odd[4].lang_pred == "aa"
    assert language.identify(docs.select("doc_id", "text").limit(0), model).count() == 0


def test_language_without_any_learned(spark):
    docs = table(spark, [(1, "text", None, 0)], "lang string")
    assert language.identify(docs.select("doc_id", "text"), language.language_model(docs)).first().lang_pred == "und"


def test_language_sums_against_plain():
    model = language.train([(in_language(x), x) for x in FORMS for _ in range(5)])
    from sparktide.llm.points import grams

    def plain(text):
        letters, last = [], False
        for c in text.lower():
            if c.isalpha() or not last:
                letters.append(ord(c) if c.isalpha() else 32)
            last = not c.isalpha()
        points = np.array(letters, np.uint32)
        return sum((model.logs[:, grams(points[i : i + n], n, language.BITS)[0]] for n in language.LENGTHS for i in range(len(points) - n + 1)), np.zeros(3))

    texts = ["Kala, mika  tasa!", "x", "qyth zoxy 12", "drub-grud kala"]
    for _, offsets, raw in text_slices(pa.array(texts, pa.large_string())):
        names, _ = model.rows(raw, offsets)
        assert names == [model.languages[int(np.argmax(plain(t)))] for t in texts]
