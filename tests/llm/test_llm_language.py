import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import language
from reviewloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_features(text):
    """n-grams of the folded, framed text, one at a time."""
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    framed = " " + " ".join(folded.split()) + " " if folded.split() else " "
    out = []
    for n in language.ORDERS:
        for i in range(len(framed) - n + 1):
            h = 0x9E3779B1 * n & 0xFFFFFFFF
            for c in framed[i : i + n]:
                h = ((h ^ ord(c)) * 0x85EBCA6B) & 0xFFFFFFFF
                h ^= h >> 15
            out.append(h & (language.DIMS - 1))
    return out


def test_ngrams_equal_brute_force():
    texts = ["Hello, World!", "", "   ", "a", "12 3", "ÀÉ straße İ x", "日本語 text 𝒜𝒷 ", "  lead", "tail  ", "\n\t"]
    h, begins, counts = language.ngrams(texts)
    for i, text in enumerate(texts):
        mine = [f for b, c in zip(begins[i :: len(texts)], counts[i :: len(texts)]) for f in h[b : b + c].tolist()]
        assert mine == brute_features(text), text


def test_logits_do_not_depend_on_neighbours_and_cover_whole_texts(monkeypatch):
    r = np.random.default_rng(1)
    model = language.Model(["a", "b"], r.normal(size=(2, language.DIMS)), np.array([0.1, -0.2]), 1.0)
    texts = ["one two", None, "drei vier fünf", "", "x" * 5000 + " the end"]
    together = model.logits(texts)[0]
    for text, row in zip(texts, together):
        np.testing.assert_array_equal(model.logits([text])[0][0], row)
    weights = model.weights[:, brute_features("drei vier fünf")].mean(axis=1) * language.UNIT + model.intercepts
    np.testing.assert_allclose(together[2], weights)
    monkeypatch.setattr(language, "PIECE", 100)  # a long text in pieces
    np.testing.assert_array_equal(model.logits(texts)[0][2], together[2])
    assert model.logits([texts[4]])[1] > 4900 * 2


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language_id"](spark, SF).join(docs, "doc_id")
    assert got.count() == docs.count()
    held = got.filter("held_out")
    assert held.count() > 100 and held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    import zlib

    for r in got.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_languages_and_sources_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", language.held_out(F.col("doc_id")))
    model = language.fit(docs.filter("not held"), sample_rows=200)
    one = docs.select("doc_id", "text")
    two = docs.select((F.col("doc_id") + 5).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(1).alias("score"), F.lit("q").alias("lang_pred"))
    a = sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(one, model).collect())
    b = sorted((r.doc_id - 5, r.lang_pred, r.score) for r in language.identify(two, model).collect())
    assert a == b
    again = language.fit(docs.filter("not held").repartition(7), sample_rows=200)
    np.testing.assert_allclose(model.weights, again.weights)


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("aa bb cc", "x"), ("dd ee ff", "y")] * 30)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "aa bb"), (4, "dd"), (4, "dd"), (5, "aa " * 500_000)], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.score > 0) for r in language.identify(odd, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und", False), (2, "und", False), (3, "und", False), (None, "x", True), (4, "y", True), (4, "y", True), (5, "x", True)], key=str)
    assert language.identify(odd.limit(0), model).collect() == []
    none = language.fit(docs.limit(0))
    assert none.languages == [] and {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    nulls = spark.createDataFrame([(None, "a", "x"), (1, None, "x"), (2, "a", None)], "doc_id long, text string, lang string")
    assert language.fit(nulls).languages == []


def test_temperature_mends_confidence():
    r = np.random.default_rng(3)
    logits = r.normal(size=(4000, 3)) * 2
    p = language.softmax(logits)
    right = np.array([r.choice(3, p=q) for q in p])
    assert language.temperature(logits * 5, right) == pytest.approx(5, rel=0.15)
    assert language.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_ftrl_learns_and_leaves_noise_at_zero():
    r = np.random.default_rng(5)
    learner = language.Ftrl(2, 50, l1=0.5)
    for _ in range(800):
        y = int(r.integers(2))
        at = np.array([y, *r.choice(np.arange(2, 50), 3, replace=False)])
        learner.learn(at, np.ones(4), y)
    w = learner.weights()
    assert w[0, 0] > 1 and w[1, 1] > 1 and (w[:, 2:50] == 0).mean() > 0.2
