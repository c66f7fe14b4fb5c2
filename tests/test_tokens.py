import math
from collections import Counter

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from reviewloom.functions.porter import porter_stem
from reviewloom.operators import tokens as tk
from reviewloom.operators import topics_cluster as tc
from reviewloom.operators import topics_lda as tl
from reviewloom.params import Params

STEMS = {
    # published examples of the algorithm
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "valenci": "valenc", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "homologou": "homolog", "communism": "commun", "activate": "activ", "angulariti": "angular",
    "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    # words of the subject
    "day": "dai", "policies": "polici", "christmas": "christma", "exchange": "exchang", "delivery": "deliveri",
    "delays": "delai", "business": "busi", "buy": "bui", "money": "monei", "company": "compani", "packaging": "packag",
    "received": "receiv", "quality": "qualiti", "services": "servic", "is": "is", "reply": "repli",
}


def test_porter(spark):
    df = spark.createDataFrame([(w,) for w in STEMS], "w string")
    got = {r.w: r.s for r in porter_stem(df, "w", "s").collect()}
    assert {w: s for w, s in got.items() if STEMS[w] != s} == {}


def reviews(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_ix long, review_full_text string").repartition(3)


def test_token_array_keeps_order_repeats_and_empty_rows(spark):
    params = Params(stopwords=["the", "and"])
    texts = ["The Parcel and the parcels, delivery DELIVERED late late", "", "the and 123", "Terrible! bad experience; didn't reply"]
    got = {r.row_ix: r.tokens for r in tk.token_array(reviews(spark, texts), params).collect()}
    assert got[0] == ["parcel", "parcel", "delivery", "delivery", "late", "late"]
    assert got[1] == [] and got[2] == []
    # terrible, bad and experience are produced by the map and then dropped
    assert got[3] == ["didn", "repli"]


def test_token_array_joins_rows_of_one_number(spark):
    rows = [(1, "late parcel"), (2, "rude staff rude"), (1, "parcel lost again"), (3, ""), (None, "lost")]
    df = spark.createDataFrame(rows, "row_ix long, review_full_text string").repartition(3)
    for frequent in (1, 3, 50_000):
        params = Params(stopwords=["again"], custom_stopwords=[], stem_map={}, frequent_words=frequent)
        got = {r.row_ix: r.tokens for r in tk.token_array(df, params).collect()}
        assert got == {1: ["late", "parcel", "lost", "parcel"], 2: ["rude", "staff", "rude"], 3: [], None: ["lost"] if frequent > 3 else got[None]}


def corpus(spark, n=60):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}x" for i in range(12)]
    docs = [[words[j] for j in rng.choice(12, rng.integers(0, 9), p=np.arange(1, 13) / 78)] for _ in range(n)]
    return docs, spark.createDataFrame(list(enumerate(docs)), "row_ix long, tokens array<string>").repartition(4)


def test_features_counts_and_tfidf_against_plain_python(spark):
    docs, tokens = corpus(spark)
    params = Params(min_df=8, max_df=0.5, max_features=5)
    df, tf = Counter(w for d in docs for w in set(d)), Counter(w for d in docs for w in d)
    allowed = [w for w in df if df[w] >= 8 and df[w] <= 0.5 * len(docs)]
    chosen = sorted(sorted(allowed, key=lambda w: (-tf[w], w))[:5])
    found = tk.feature_terms(tokens, params).orderBy("term_ix").collect()
    assert [(r.term, r.df, r.corpus_tf) for r in found] == [(w, df[w], tf[w]) for w in chosen]

    expected = {}
    for i, d in enumerate(docs):
        w = {t: d.count(t) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in set(d) & set(chosen)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        expected |= {(i, t): x / norm for t, x in w.items()}
    got = {(r.row_ix, r.term): r.weight for r in tk.tfidf(tokens, params).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)

    counts = tl.count_vectors(tokens, chosen)
    rows = tc.tfidf_vectors(counts, [df[w] for w in chosen]).collect()
    as_vectors = {(r.row_ix, chosen[i]): v for r in rows for i, v in zip(r.tfidf.indices, r.tfidf.values)}
    assert as_vectors.keys() == expected.keys()
    assert all(abs(as_vectors[k] - expected[k]) < 1e-12 for k in expected)


def test_svd_matches_numpy(spark):
    docs, tokens = corpus(spark)
    terms = sorted({w for d in docs for w in d})
    vectors = tc.tfidf_vectors(tl.count_vectors(tokens, terms), [1] * len(terms))
    dense = {r.row_ix: r.tfidf.toArray() for r in vectors.collect()}
    matrix = np.array([dense[i] for i in range(len(docs))])
    rows, singular = tc.embed_svd(vectors, 4)
    got = {r.row_ix: r.vec for r in rows.collect()}
    ours = np.array([got[i] for i in range(len(docs))])
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(singular, s[:4])
    assert np.allclose(np.abs(ours), np.abs(u[:, :4] * s[:4]), atol=1e-8)
    assert not ours[[i for i, d in enumerate(docs) if not d]].any()


def test_svd_of_planted_rank_among_many_features(spark):
    """Rank five among 20,000 features, for two and seven partitions; the driver holds features x 15 numbers."""
    n, rank, r = 20_000, 5, np.random.default_rng(3)
    words = [r.choice(n, 40, replace=False) for _ in range(rank)]
    scale = [9.0, 7.0, 5.0, 3.0, 1.0]
    rows = [(i, i % rank, float(1 + i % 4)) for i in range(400)]
    matrix = np.zeros((400, n))
    data = []
    for i, g, times in rows:
        matrix[i, words[g]] = scale[g] * times
        at = sorted(words[g].tolist())
        data.append((i, Vectors.sparse(n, at, [scale[g] * times] * len(at))))
    data.append((400, Vectors.sparse(n, [], [])))
    want = np.linalg.svd(matrix @ matrix.T, compute_uv=False)[:rank] ** 0.5
    for parts in (2, 7):
        df = spark.createDataFrame(data, ["row_ix", "tfidf"]).repartition(parts)
        found, singular = tc.embed_svd(df, rank)
        got = {x.row_ix: np.array(x.vec) for x in found.collect()}
        ours = np.array([got[i] for i in range(400)])
        assert np.allclose(singular, want, rtol=1e-9)
        assert np.allclose(ours @ ours.T, matrix @ matrix.T, atol=1e-6)
        assert not got[400].any()


def test_svd_settles_on_slowly_falling_values(spark):
    r = np.random.default_rng(8)
    matrix = r.normal(size=(600, 80)) * (0.8 ** np.arange(80))
    data = [(i, Vectors.sparse(80, list(range(80)), x.tolist())) for i, x in enumerate(matrix)]
    df = spark.createDataFrame(data, ["row_ix", "tfidf"]).repartition(5)
    _, singular = tc.embed_svd(df, 6)
    assert np.allclose(singular, np.linalg.svd(matrix, compute_uv=False)[:6], rtol=1e-6)


def test_svd_merges_triangles_in_a_tree_and_takes_empty_tables(spark):
    data = [(i, Vectors.sparse(4, [i % 4], [float(i)])) for i in range(200)]
    df = spark.createDataFrame(data, ["row_ix", "tfidf"]).repartition(40, "row_ix")
    _, singular = tc.embed_svd(df, 4)
    want = sorted((sum(i * i for i in range(200) if i % 4 == f) ** 0.5 for f in range(4)), reverse=True)
    assert np.allclose(singular, want)
    found, singular = tc.embed_svd(df.filter("row_ix < 0"), 4)
    assert found.count() == 0 and len(singular) == 0


def test_hot_word_counts_are_whole(spark):
    tokens = spark.range(2000).select(F.col("id").alias("row_ix"), F.array(F.lit("hot"), F.lit("hot"), F.concat(F.lit("t"), F.col("id") % 7)).alias("tokens"))
    found = {r.term: (r.df, r.corpus_tf) for r in tk.feature_terms(tokens, Params(max_df=1.0)).collect()}
    assert found["hot"] == (2000, 4000) and len(found) == 8
