import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import toxicity


def corpus(n=600):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    bad = ["idiot", "scum", "trash", "moron", "loser"]
    docs, labels = [], []
    for i in range(n):
        text = list(r.choice(words, int(r.integers(5, 80))))
        k = int(r.integers(1, 6)) if i % 4 == 0 else 0
        for b in r.choice(bad, k, replace=False):
            text.insert(int(r.integers(len(text))), b.upper() if i % 8 == 0 else b)
        docs.append((i, " ".join(text), k))
        if i % 3:
            labels.append((i, 1, int(k > 0)))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string, grade int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found_and_clean_ones_left_alone(spark):
    docs, labels = frames(spark)
    got = toxicity.grade(docs, toxicity.fit(docs, labels)).join(docs.select("doc_id", F.col("grade").alias("k")), "doc_id").collect()
    assert len(got) == docs.count()
    assert sum(r.toxic != (r.k > 0) for r in got) <= 0.02 * len(got)
    mean = lambda k: np.mean([r.severity for r in got if r.k == k])
    assert mean(0) < mean(1) < mean(3) < mean(5)


def test_same_model_whatever_the_partitions(spark):
    docs, labels = frames(spark)
    a, b = toxicity.fit(docs, labels, 200), toxicity.fit(docs.repartition(5), labels.union(labels).repartition(3), 200)
    np.testing.assert_array_equal(a.features, b.features)
    np.testing.assert_allclose(a.weights, b.weights)
    assert (np.diff(a.thresholds) >= 0).all()


def test_gradient_leads_to_the_minimum():
    r = np.random.default_rng(1)
    rows = [np.flatnonzero(r.random(6) < 0.5) for _ in range(400)]
    score = np.array([2.0 * (0 in x) + 1.0 * (1 in x) for x in rows]) + r.logistic(size=400)
    grades = (score[:, None] > np.array([0.5, 2.0])).sum(axis=1)
    model = toxicity.fit_ordinal(rows, grades, np.ones(400), l1=0.0, rounds=2000)

    def loss(weights, cuts):
        s = np.array([weights[x].sum() for x in rows])
        edges = np.column_stack([np.full(400, -np.inf), np.broadcast_to(cuts, (400, 2)), np.full(400, np.inf)])
        p = toxicity.sigmoid(edges[np.arange(400), grades + 1] - s) - toxicity.sigmoid(edges[np.arange(400), grades] - s)
        return -np.log(p).mean()

    w = np.zeros(6)
    w[model.features] = model.weights
    best = loss(w, model.thresholds)
    for i in range(6):
        for step in (-0.05, 0.05):
            moved = w.copy()
            moved[i] += step
            assert loss(moved, model.thresholds) >= best - 1e-6
    for i in range(2):
        for step in (-0.05, 0.05):
            moved = model.thresholds.copy()
            moved[i] += step
            assert loss(w, moved) >= best - 1e-6


def test_scores_equal_brute_force():
    model = toxicity.Model(np.sort([zlib_feature("bad"), zlib_feature("é")]), np.array([1.5, -0.5]), np.array([0.0, 1.0]))
    texts = [b"BAD bad, bad! fine", None, b"", "é x".encode(), b"good " * 2_000_000 + b"bad"]
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    want = [weight[zlib_feature("bad")], 0, 0, weight[zlib_feature("é")], weight[zlib_feature("bad")]]
    np.testing.assert_allclose(model.scores(texts), want)
    above = model.above(texts)
    assert above.shape == (5, 2) and (above[:, 0] >= above[:, 1]).all()


def zlib_feature(word):
    import zlib

    return zlib.crc32(f"<{word}>".encode()) & (toxicity.DIMS - 1)


def test_features_of_words():
    word, feature = toxicity.dictionary_features([b"a", b"abcd", b"xabcd"])
    runs = [set(feature[word == i].tolist()) for i in range(3)]
    assert [len(r) for r in runs] == [1, 3, 4]  # the word and its runs: none, <abcd abcd>, and three
    assert len(runs[1] & runs[2]) == 1  # abcd>


def test_odd_rows_and_missing_labels(spark):
    docs, labels = frames(spark)
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "idiot scum", 1), (3, "idiot", 1), (3, "idiot", 1)], "doc_id long, text string, toxic int")
    got = toxicity.grade(odd, model).collect()
    assert len(got) == 5 and not any(r.toxic for r in got if r.doc_id in (1, 2)) and all(r.toxic for r in got if r.doc_id not in (1, 2))
    assert toxicity.grade(odd.limit(0), model).collect() == []
    for some in (labels.limit(0), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.fit(docs, some) is None
    assert {(r.severity, r.toxic) for r in toxicity.grade(odd, None).collect()} == {(None, False)}
    clash = labels.unionByName(spark.createDataFrame([(None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.fit(docs, clash.withColumn("text", F.lit("idiot"))) is not None


def test_given_labels(spark):
    from reviewloom.llm.queries import QUERIES

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("toxic", "label")
    got = QUERIES["op7_toxicity_severity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    right = got.filter(F.col("toxic") == (F.col("label") == 1)).count()
    assert right >= 0.95 * got.count()


@pytest.mark.parametrize("n", [1, 5])
def test_best_cut(n):
    p = np.array([0.9, 0.8, 0.8, 0.3] * n)
    assert 0.3 < toxicity.best_cut(p, p > 0.5, np.ones(len(p))) <= 0.8
