import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import coherence as co
from reviewloom.operators import labels as lb
from reviewloom.operators import report as rp
from reviewloom.operators import topics_cluster as tc
from reviewloom.operators import vector_blocks as vb
from reviewloom.operators import topics_lda as tl
from reviewloom.params import LABEL_CONSTRUCTS, LDA_CONSTRUCTS, LDA_LABELS, Params


# --- clusters --------------------------------------------------------------------------


def brute_clusters(points, eps, min_pts, min_size):
    """All-pairs density clustering on unit vectors, by row."""
    n = len(points)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = np.linalg.norm(unit[:, None] - unit[None], axis=2) <= eps
    core = near.sum(axis=1) >= min_pts
    label = np.full(n, -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = i
                    stack.extend(np.flatnonzero(near[j] & core & (label < 0)))
    distance = np.linalg.norm(unit[:, None] - unit[None], axis=2)
    for i in np.flatnonzero(~core):
        candidates = np.flatnonzero(near[i] & core)
        if len(candidates):
            label[i] = label[candidates[np.argmin(distance[i, candidates])]]
    groups = [g for g in set(label) if g >= 0 and (label == g).sum() >= min_size]
    groups.sort(key=lambda g: (-(label == g).sum(), np.flatnonzero(label == g)[0]))
    ids = {g: k for k, g in enumerate(groups)}
    return [ids.get(g, -1) for g in label]


def vectors(spark, points, parts=4):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "row_ix long, vec array<double>").repartition(parts)


def found(df):
    return [r.cluster_id for r in df.orderBy("row_ix").collect()]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_clusters_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    points = np.vstack([c + 0.25 * rng.normal(size=(n, 6)) for c, n in zip(centres, (40, 25, 12, 4))] + [rng.normal(size=(25, 6))])
    points = points[rng.permutation(len(points))]
    for eps, min_pts, min_size in ((0.3, 4, 6), (0.45, 6, 10), (0.15, 2, 3)):
        got = found(tc.density_clusters(vectors(spark, points), eps, min_pts, min_size))
        assert got == brute_clusters(points, eps, min_pts, min_size)


def test_clusters_do_not_depend_on_partitions_or_copies(spark):
    rng = np.random.default_rng(7)
    base = np.vstack([rng.normal(size=(1, 5)) + 0.1 * rng.normal(size=(30, 5)) for _ in range(3)])
    hot = np.repeat(base[:1], 60, axis=0)  # copies of one vector
    points = np.vstack([base, hot])
    expected = brute_clusters(points, 0.4, 5, 10)
    for parts in (1, 7):
        assert found(tc.density_clusters(vectors(spark, points, parts), 0.4, 5, 10)) == expected


def test_small_clusters_in_much_noise(spark):
    """Twenty clusters of 80 rows among 30,000 rows of noise, each direction different."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 12))
    points = np.vstack([c / np.linalg.norm(c) + 0.02 * rng.normal(size=(80, 12)) for c in centres] + [rng.normal(size=(30_000, 12))])
    order = rng.permutation(len(points))
    got = np.array(found(tc.density_clusters(vectors(spark, points[order], 6), 0.2, 5, 75)))
    label = np.empty(len(points), dtype=int)
    label[order] = got
    assert got.max() == 19 and all(len(set(label[80 * i : 80 * i + 80])) == 1 and label[80 * i] >= 0 for i in range(20))
    assert (got >= 0).sum() >= 1600


def test_clusters_over_many_blocks_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(size=(1, 4)) + 0.2 * rng.normal(size=(90, 4)) for _ in range(6)] + [rng.normal(size=(200, 4))])
    monkeypatch.setattr(tc, "BLOCK", 50)
    for parts in (2, 5):
        assert found(tc.density_clusters(vectors(spark, points, parts), 0.15, 4, 8)) == brute_clusters(points, 0.15, 4, 8)


def test_zero_vectors_and_no_cores(spark):
    points = np.vstack([np.zeros((20, 3)), np.eye(3)])
    assert found(tc.density_clusters(vectors(spark, points), 0.5, 2, 2)) == [-1] * 23
    assert found(tc.density_clusters(vectors(spark, np.zeros((3, 2))), 0.5, 2, 2)) == [-1] * 3


# --- descriptions ----------------------------------------------------------------------

DOCS = [
    (0, 0, ["a", "b", "a", "c"]), (1, 0, ["a", "c"]), (2, 1, ["b", "b", "d"]), (3, 1, ["d", "e", "d", "b"]), (4, -1, ["c", "e"]),
    (5, 1, ["d", "e", "d", "b"]),
]


def given(spark):
    return spark.createDataFrame(DOCS, "row_ix long, topic_id long, tokens array<string>").repartition(3)


def brute_weights(max_features=2500):
    total = Counter(t for _, _, ts in DOCS for t in ts)
    keep = set(sorted(total, key=lambda t: (-total[t], t))[:max_features])
    per = {}
    for _, c, ts in DOCS:
        per.setdefault(c, Counter()).update(t for t in ts if t in keep)
    mean = math.floor(sum(sum(v.values()) for v in per.values()) / len(per))
    return {(c, t): f / sum(v.values()) * math.log(1 + mean / total[t]) for c, v in per.items() for t, f in v.items()}


@pytest.mark.parametrize("max_features", [2500, 3])
def test_class_tfidf(spark, max_features):
    expected = brute_weights(max_features)
    got = {(r.topic_id, r.term): r.weight for r in tc.topic_term_weights(given(spark), max_features).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)


def test_top_terms_labels_and_info(spark):
    docs = given(spark)
    weights = tc.topic_term_weights(docs)
    terms = tc.ctfidf_terms(weights, 2)
    rows = {(r.topic_id, r["rank"]): r for r in terms.collect()}
    assert rows[1, 1].term == "d" and rows[1, 1].topic_label == "d | " + rows[1, 2].term
    reviews = docs.select("row_ix", F.array_join("tokens", " ").alias("review_full_text"))
    info = {r.bertopic_topic_id: r for r in tc.topic_info(reviews, docs, weights, terms, per_topic=2).collect()}
    assert info[1].n_reviews == 3 and info[1].Name.startswith("1_d_") and info[1].Representation[0] == "d"
    assert info[1].Representative_Docs == ["d e d b", "d e d b"] and info[-1].Representative_Docs == ["c e"]


def test_topic_assign_unknown_topic_is_outlier(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "row_ix long")
    ids = spark.createDataFrame([(1, 0), (2, -1)], "row_ix long, cluster_id long")
    terms = spark.createDataFrame([(0, "x | y", 1), (0, "x | y", 2)], "topic_id long, topic_label string, rank long")
    got = {r.row_ix: (r.bertopic_topic_id, r.bertopic_topic_label) for r in tc.topic_assign(df, ids, terms).collect()}
    assert got == {1: (0, "x | y"), 2: (-1, "outlier"), 3: (None, "outlier")}


# --- LDA -------------------------------------------------------------------------------


def test_lda_separates_and_keeps_its_invariants(spark):
    rng = np.random.default_rng(2)
    left, right = [f"l{c}" for c in "abcdefghijkl"], [f"r{c}" for c in "abcdefghijkl"]
    docs = [(i, list(rng.choice(left if i % 2 else right, 15))) for i in range(120)]
    tokens = spark.createDataFrame([(i, [str(w) for w in d]) for i, d in docs], "row_ix long, tokens array<string>")
    terms = sorted(left + right)
    counts = tl.count_vectors(tokens, terms).cache()
    model = tl.lda_fit(counts, Params(lda_topics=2))
    top = tl.lda_topic_terms(spark, model, terms, 10).cache()
    for topic in (0, 1):
        rows = top.filter(F.col("topic_id") == topic).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(1, 11)) and len({r.term[0] for r in rows}) == 1
        assert all(a.weight >= b.weight for a, b in zip(rows, rows[1:]))
        assert rows[0].topic_label == " | ".join(r.term for r in rows[:3])
    weights = tl.dominant_topic(tl.lda_weights(counts, model), top).collect()
    assert len(weights) == 120 and all(abs(sum(r.topic_weights) - 1) < 1e-9 for r in weights)
    assert len({(r.row_ix % 2, r.dominant_topic_id) for r in weights}) == 2
    blank = spark.createDataFrame([(1, []), (2, ["unknown"])], "row_ix long, tokens array<string>")
    even = tl.dominant_topic(tl.lda_weights(tl.count_vectors(blank, terms), model), top).collect()
    assert [(r.topic_weights, r.dominant_topic_id) for r in even] == [([0.5, 0.5], 0)] * 2
    with pytest.raises(ValueError):
        tl.count_vectors(tokens, [])


def plain_lda(matrix, k, seed, passes):
    """Batch variational Bayes on a dense matrix, one row after the other."""
    from math import exp

    psi = lambda x: np.vectorize(lambda v: float(tl.digamma(np.array([v]))[0]))(x)
    topics, alpha = tl.start_topics(seed, k, matrix.shape[1]), 1 / k
    for _ in range(passes):
        beta = np.exp(psi(topics) - psi(topics.sum(axis=1))[:, None])
        sums = np.zeros_like(topics)
        for row in matrix:
            gamma = np.full(k, alpha + row.sum() / k)
            for _ in range(tl.INNER_ROUNDS):
                theta = np.exp(psi(gamma) - psi(gamma.sum()))
                new = alpha + theta * (beta @ (row / (theta @ beta + exp(-230))))
                change = np.abs(new - gamma).mean()
                gamma = new
                if change < tl.INNER_CHANGE:
                    break
            theta = np.exp(psi(gamma) - psi(gamma.sum()))
            sums += np.outer(theta, row / (theta @ beta + exp(-230)))
        topics = 1 / k + sums * beta
    return topics


def test_lda_equals_a_plain_fit_whatever_the_partitions(spark):
    rng = np.random.default_rng(4)
    matrix = rng.poisson(0.6, size=(60, 15)) * (rng.random((60, 15)) < 0.5)
    terms = [f"w{i:02d}" for i in range(15)]
    rows = [(i, [t for t, n in zip(terms, row) for _ in range(n)]) for i, row in enumerate(matrix.tolist())]
    tokens = spark.createDataFrame(rows, "row_ix long, tokens array<string>")
    params = Params(lda_topics=3, lda_iterations=4)
    fits = [tl.lda_fit(tl.count_vectors(tokens.repartition(n), terms), params).topics for n in (2, 7)]
    np.testing.assert_allclose(fits[0], fits[1], rtol=1e-9)
    np.testing.assert_allclose(fits[0], plain_lda(matrix, 3, params.seed, 4), rtol=1e-6)


def test_lda_reads_every_row_in_a_pass(spark):
    tokens = spark.createDataFrame([(i, [f"t{i:03d}", "all"]) for i in range(300)], "row_ix long, tokens array<string>")
    terms = sorted({*(f"t{i:03d}" for i in range(300)), "all"})
    model = tl.lda_fit(tl.count_vectors(tokens, terms), Params(lda_iterations=1))
    assert (model.topics.sum(axis=0) > 6 * (1 / 6) + 0.5).all()  # each private term has the mass of its one row


def test_lda_updates_rows_in_blocks_of_few_counts():
    sizes = [400] * 300 + [0] * 5 + [tl.BLOCK + 1, 3, 0]
    indices = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    values = pa.array([[float(i + 1)] * n for i, n in enumerate(sizes)], pa.list_(pa.float64()))
    column = pa.StructArray.from_arrays([indices, values], names=["indices", "values"])[1:]
    blocks = list(tl._runs(column))
    assert [b[0] for b in blocks] == [0, *(b[1] for b in blocks[:-1])] and blocks[-1][1] == len(column)
    assert all(len(n) * 8 * 6 < 2_000_000 or stop == start + 1 for start, stop, _, _, n in blocks)
    assert [x for _, _, _, _, n in blocks for x in n] == [float(i + 1) for i, n in enumerate(sizes) if i for _ in range(n)]
    beta = np.random.default_rng(1).random((3, tl.BLOCK + 1))
    whole = [tl.row_topics(bounds, term, n, beta, 1 / 3) for _, _, bounds, term, n in blocks]
    alone = [tl.row_topics(np.array([0, m]), np.arange(m), np.full(m, float(i + 1)), beta, 1 / 3) for i, m in enumerate(sizes) if i]
    np.testing.assert_array_equal(np.concatenate(whole), np.concatenate(alone))


def test_digamma():
    from math import lgamma

    x = np.array([0.05, 0.3, 1.0, 2.5, 7.0, 100.0])
    h = 1e-6
    np.testing.assert_allclose(tl.digamma(x), [(lgamma(v * (1 + h)) - lgamma(v * (1 - h))) / (2 * h * v) for v in x], rtol=1e-5)


def test_dominant_topic_takes_the_first_of_a_tie(spark):
    w = spark.createDataFrame([(1, [0.4, 0.4, 0.2])], "row_ix long, topic_weights array<double>")
    terms = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "topic_id long, topic_label string")
    row = tl.widen_weights(tl.dominant_topic(w, terms), 3).first()
    assert (row.dominant_topic_id, row.dominant_topic_label, row.topic_2) == (0, "t0", 0.2)


# --- coherence -------------------------------------------------------------------------


def brute_cv(docs, topics, window, eps=1e-12):
    windows = [set(d[i : i + window]) for d in docs if d for i in range(max(1, len(d) - window + 1))]
    n = len(windows)

    def p(*words):
        return sum(all(w in s for w in words) for s in windows) / n

    def npmi(w, u):
        both = p(w, u)
        if not p(w) or not p(u):
            return 0.0
        return 1.0 if both == 1 else math.log((both + eps) / (p(w) * p(u))) / -math.log(both + eps)

    scores = []
    for words in topics:
        m = np.array([[npmi(w, u) for u in words] for w in words])
        s = m.sum(axis=0)
        lengths = np.linalg.norm(m, axis=1) * np.linalg.norm(s)
        scores.append(np.mean([0.0 if not k else row @ s / k for row, k in zip(m, lengths)]))
    return scores


@pytest.mark.parametrize("window", [1, 3, 6, 110])
def test_coherence_matches_listed_windows(spark, window):
    rng = np.random.default_rng(11)
    words = list("abcdefgh")
    docs = [[str(w) for w in rng.choice(words, rng.integers(0, 16))] for _ in range(40)]
    topics = [["a", "b", "c"], ["c", "d", "e", "zz"], ["f", "a"]]
    tokens = spark.createDataFrame(list(enumerate(docs)), "row_ix long, tokens array<string>").repartition(5)
    rows = [(i, f"t{i}", r, w) for i, ws in enumerate(topics) for r, w in enumerate(ws, 1)]
    terms = spark.createDataFrame(rows, "topic_id long, topic_label string, rank long, term string")
    got = {r.topic_id: r.coherence_cv for r in co.coherence_cv(tokens, terms, "LDA", window).collect()}
    expected = brute_cv(docs, topics, window)
    assert [round(got[str(i)], 9) for i in range(3)] == [round(x, 9) for x in expected]
    assert abs(got["overall"] - np.mean(expected)) < 1e-9
    lists = {r.topic_id: r.terms for r in co.topic_word_lists(terms).collect()}
    assert lists == dict(enumerate(topics))


def test_window_starts_of_rows_cut_into_batches_and_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 7)
    rng = np.random.default_rng(3)
    docs = {i: [str(w) for w in rng.choice(list("abcdefgh"), rng.integers(0, 40))] for i in range(30)}
    rows = [(i, d, ["x", "y"] if i % 2 else ["x"]) for i, d in docs.items()]
    tokens = spark.createDataFrame(rows + rows[::4], "row_ix long, tokens array<string>, models array<string>")
    sets = [(m, a, b, t) for m, a, b in [("x", "a", "a"), ("x", "a", "c"), ("y", "a", "c"), ("y", "f", "g")] for t in {a, b}]
    sets = spark.createDataFrame(sets, "model string, a string, b string, term string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r.model, r.a, r.b): r.n for r in co.model_window_counts(tokens, sets, 6).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for model, a, b in got:
        mine = [d for i, d in docs.items() if d and (model == "x" or i % 2)]
        want[model, a, b] = sum(bool({a, b} & set(d[i : i + 6])) for d in mine for i in range(max(1, len(d) - 5)))
    assert len(got) == 4 and got == want


# --- labels and reports ----------------------------------------------------------------


def test_labels(spark):
    df = spark.createDataFrame([(0, "a"), (7, "b")], "topic_id long, topic_label string")
    rows = lb.apply_labels(df, "topic_id", "topic_label", LDA_LABELS, "x").collect()
    assert [r.x for r in rows] == [LDA_LABELS[0], "b"]
    table = spark.createDataFrame([(7, "seven")], "k long, v string")
    assert sorted(r.x for r in lb.apply_labels(df, "topic_id", "topic_label", table, "x").collect()) == ["a", "seven"]
    same = spark.createDataFrame([(0, "a"), (4, "a"), (1, "b"), (1, "b")], "topic_id long, topic_label string")
    got = {r.topic_label: r.publication_label for r in lb.label_map_inverse(same, LDA_LABELS).collect()}
    assert got == {"a": LDA_LABELS[4], "b": LDA_LABELS[1]}


def test_constructs(spark):
    labels = spark.createDataFrame([(1, LDA_LABELS[1]), (9, "raw")], "topic_id long, publication_label string")
    by_id = lb.construct_map_ids(labels, LDA_CONSTRUCTS)
    by_label = lb.construct_map_labels(
        spark.createDataFrame([("Severe Service Failure",), ("other",), ("other",), (None,)], "publication_label string"), LABEL_CONSTRUCTS
    )
    rows = [(r.model, r.topic_id, r.publication_label, r.primary_construct) for r in lb.construct_union(by_id, by_label).collect()]
    assert rows == [
        ("LDA", "1", LDA_LABELS[1], "Low Service Quality"), ("LDA", "9", "raw", ""),
        ("BERTopic", "", "Severe Service Failure", "Brand Hate"), ("BERTopic", "", "other", ""),
    ]


def test_quotes_skip_short_and_repeated_texts(spark):
    long = "x" * 90
    rows = [
        (1, 0, 0.9, 70, 0.0, "short", "A", 1.0), (2, 0, 0.9, 60, 0.0, long + "1", "A", 1.0), (3, 0, 0.9, 75, 0.1, long + "2", "B", 1.0),
        (4, 0, 0.9, 75, 0.0, long + "2", "B", 2.0), (5, 0, 0.95, 1, 0.0, long + "1", "C", 3.0), (6, 1, 0.5, 70, 0.0, "y" * 700, "A", 1.0),
        (7, 2, 0.5, 70, 0.0, "z" * 100, "A", 1.0),
    ]
    scored = spark.createDataFrame(
        rows, "row_ix long, dominant_topic_id long, membership double, token_count long, compound double, review_full_text string, brand string, reviewer_rating double"
    )
    summary = spark.createDataFrame([(0, "zero"), (1, "one"), (5, "none")], "topic_id long, publication_label string")
    got = rp.representative_quotes(scored.repartition(3), summary).collect()
    assert [(r.topic_id, r.quote_rank, r.brand, len(r.quote_excerpt)) for r in got] == [(0, 1, "C", 91), (0, 2, "B", 91), (1, 1, "A", 600)]
    assert got[1].reviewer_rating == 2.0 and got[0].publication_label == "zero"


def test_report_texts(spark):
    dist = spark.createDataFrame(
        [("B", "t", 30.0, 3), ("A", "t", 30.0, 6), ("C", "t", 12.25, 1)], "brand string, publication_label string, pct_reviews double, n_reviews long"
    )
    assert rp.topk_brands_per_topic(dist, ["C", "B", "A"]).first().top_brands == "B (30.0%); A (30.0%)"
    aspects = spark.createDataFrame(
        [("A", "x", 50.0, 5), ("A", "y", 25.0, 2), ("A", "z", 25.0, 2), ("B", "x", 100.0, 1)], "brand string, aspect_top_category string, pct_reviews double, n_reviews long"
    )
    got = {r.brand: r.top_aspects for r in rp.topk_aspects_per_brand(aspects).collect()}
    assert got == {"A": "x (50.0%); y (25.0%)", "B": "x (100.0%)"}
    assert rp.overall_top_aspects(aspects).first()[0] == "x (60.0%); y (20.0%); z (20.0%)"


def planted_clusters(n, dims, size, seed, noise=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dims))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    near = np.repeat(centres, size, axis=0) + rng.normal(size=(n * size, dims)) * 0.02
    return np.concatenate([near, rng.normal(size=(noise, dims))])


def shipped_rows(spark, points, eps):
    rows = tc._directions(vectors(spark, points)).select(F.col("row_ix").alias("id"), F.lit(1).cast("long").alias("n"), "unit")
    index = vb.build_index(rows, len(points), 64, eps, group_rows=512)
    sizes = index.blocks.groupBy("cell").agg(F.sum(F.length("ids") / 8).alias("size"))
    return vb.asked_cells(index, eps).join(sizes, "cell").agg(F.sum("size")).first()[0]


def test_what_the_index_ships_grows_with_the_vectors(spark):
    """Clusters of 80 vectors, twice as many: twice the rows shipped, and hardly more than there are."""
    few, many = (planted_clusters(n, 24, 80, 5) for n in (40, 80))
    a, b = shipped_rows(spark, few, 0.25), shipped_rows(spark, many, 0.25)
    assert len(few) <= a < 1.5 * len(few) and len(many) <= b < 1.5 * len(many)


def test_every_vector_in_reach_is_shipped(spark):
    rng = np.random.default_rng(8)
    points = np.concatenate([planted_clusters(12, 4, 20, 6, 100), rng.normal(size=(60, 4))])
    rows = tc._directions(vectors(spark, points, 4)).select(F.col("row_ix").alias("id"), F.lit(1).cast("long").alias("n"), "unit")
    for eps, block in ((0.1, 7), (0.4, 30), (1.5, 64)):
        index = vb.build_index(rows, len(points), block, eps, group_rows=40)
        met = []

        def meet(state, at, strip, others):
            near = np.sqrt(((strip.unit[:, None] - others.unit) ** 2).sum(axis=2)) <= state["eps"]
            state["n"][at : at + len(strip.ids)] += near.sum(axis=1)

        begin = lambda own, eps=eps: {"eps": eps, "n": np.zeros(len(own.ids), np.int64)}
        end = lambda state, own: pa.RecordBatch.from_arrays([pa.array(own.ids), pa.array(state["n"])], ["id", "n"])
        met = {r.id: r.n for r in vb.over_reach(index, eps, "id long, n long", begin, meet, end).collect()}
        unit = points / np.linalg.norm(points, axis=1)[:, None]
        gaps = np.sqrt(((unit[:, None] - unit) ** 2).sum(axis=2))
        assert [met[i] for i in range(len(points))] == (gaps <= eps).sum(axis=1).tolist()


def test_vectors_of_other_groups_are_read_and_not_shuffled(spark):
    """Where all vectors are in reach of each other, every group meets them all, and no exchange holds copies of them."""
    points = np.random.default_rng(5).normal(size=(700, 8))
    rows = tc._directions(vectors(spark, points)).select(F.col("row_ix").alias("id"), F.lit(1).cast("long").alias("n"), "unit")
    index = vb.build_index(rows, len(points), 64, 2.0, group_rows=100)
    extra = index.blocks.select("block", (F.length("ids") / 8).cast("long").alias("size"))

    def meet(state, at, strip, others):
        assert all(b["size"] * 8 == len(b["ids"]) for b in others.blocks)
        state[0] += len(strip.ids) * len(others.ids)

    end = lambda state, own: pa.RecordBatch.from_arrays([pa.array(state), pa.array([len(own.ids)])], ["pairs", "n"])
    met = vb.over_reach(index, 2.0, "pairs long, n long", lambda own: [0], meet, end, extra)
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.agg(F.sum("pairs"), F.sum("n"), F.count("*") > 4).first() == (700 * 700, 700, True)
