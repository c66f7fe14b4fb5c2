import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import projection_forest
from reviewloom.llm.queries import op12_projection_forest

SF = "/root/testdata/sf0.01"


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, asked, k):
    """query_id -> [(vec_id, score)] of all candidates, best first."""
    vectors = {(i, tuple(v)) for i, v in rows if i is not None and good(v)}
    out = {}
    for q, w in {(i, tuple(v)) for i, v in asked if i is not None and good(v)}:
        best = {}
        for i, v in vectors:
            if i != q and len(v) == len(w):
                best[i] = max(best.get(i, -np.inf), float(np.dot(np.array(v, float), np.array(w, float))))
        out[q] = sorted(best.items(), key=lambda p: (-round(p[1], 9), p[0]))[:k]
    return out


def run(spark, rows, divisor, k, kind="float", **how):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], f"vec_id long, v array<{kind}>, rank int, cell double").repartition(3)
    found = projection_forest.nearest(df, df.filter(F.col("vec_id") % divisor == 0), k, **how).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in best}) for q, best in want.items())
    return hits / sum(map(len, want.values()))


def vectors(n, dims, clusters, seed, spread=0.3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(clusters, dims))[r.integers(0, clusters, n)] + spread * r.normal(size=(n, dims))
    x *= r.uniform(0.2, 3, (n, 1))  # norms differ, so inner products are no cosines
    return [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


def test_recall_order_and_scores(spark):
    rows = vectors(4000, 12, 30, 1)
    got, want = run(spark, rows, 20, 10, leaf_rows=64, tile_rows=40), brute(rows, rows[::20], 10)
    assert recall(got, want) >= 0.9 and set(got) == set(want)
    x = dict(rows)
    for q, found in got.items():
        assert len(found) == 10 and found == sorted(found, key=lambda p: (-p[1], p[0]))
        for i, s in found:
            assert s == pytest.approx(float(np.dot(np.array(x[i]), np.array(x[q]))), rel=1e-12)


def test_the_queue_takes_few_rows_where_clusters_are_apart():
    rows = vectors(20_000, 16, 200, 2, 0.05)
    x = np.array([v for _, v in rows])
    forest = projection_forest.Forest(float(np.linalg.norm(x, axis=1).max()), [], 0)
    long = forest.lengthened(x)
    forest.trees = [projection_forest.fit_tree(long[::4], 16, s) for s in range(4)]
    for tree in forest.trees:
        tree.counts = np.bincount(tree.place(long), minlength=tree.leaf[-1] + 1)
        assert tree.counts.sum() == len(x)
    queries = x[:60]
    near = [[x[j] for j in np.argsort(-(x @ q), kind="stable")[:11] if (x[j] != q).any()][:10] for q in queries]
    assert projection_forest.tuned_budget(forest, list(queries), near, 0.95) < 0.25 * len(x)


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = vectors(1200, 8, 10, 3) + [(5000 + i, [1.0] * 8) for i in range(600)]
    got, want = run(spark, rows, 10, 5, leaf_rows=32, tile_rows=20), brute(rows, [r for r in rows if r[0] % 10 == 0], 5)
    assert recall(got, want) >= 0.9
    found = [i for i, _ in got[5100]]
    assert len(found) == 5 and 5100 not in found
    copies = [i for i in found if i >= 5000]
    assert copies == [5000, 5001, 5002, 5003, 5004][: len(copies)]


def test_a_third_of_all_queries_is_one_vector_that_is_hard_to_answer(spark):
    """The others lie in narrow clusters and need few rows each."""
    r = np.random.default_rng(0)
    x = (3 * r.normal(size=(50, 48)))[r.integers(0, 50, 6000)] + 0.1 * r.normal(size=(6000, 48))
    hot = 0.05 * r.normal(size=48)
    rows = [(i, [float(c) for c in (hot if i % 3 == 0 else v)]) for i, v in enumerate(x.astype(np.float32).astype(float))]
    asked = [row for row in rows if row[0] % 20 == 0]
    got, want = run(spark, rows, 20, 20, kind="double", leaf_rows=64, tile_rows=400), brute(rows, asked, 20)
    assert recall(got, want) >= 0.9


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(projection_forest, "COPIES_AT_ONCE", 3)
    rows = [(i, [float(i % 4), 1.0]) for i in range(50)] + [(3, [3.0, 1.0]), (7, [0.5, 0.5])]
    rows += [(100, None), (110, [None, 1.0]), (120, [float("nan"), 1.0]), (130, [float("inf"), 0.0]), (None, [1.0, 1.0]), (140, []), (150, [0.0, 0.0])]
    rows += [(200, [5.0]), (210, [-2.0]), (220, [1.0, 2.0, 3.0])]
    got, want = run(spark, rows, 10, 4, kind="double"), brute(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0], 4)
    assert {q: f for q, f in got.items()} == {q: f for q, f in want.items() if f}
    assert run(spark, [], 10, 4) == {} and run(spark, [(0, [1.0])], 10, 4) == {} and run(spark, [(1, [1.0]), (2, [2.0])], 10, 4) == {}


def test_registered_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in sorted(op12_projection_forest(spark, SF).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert recall(got, want) >= 0.9 and all(len(f) == 20 for f in got.values()) and set(got) == set(want)
