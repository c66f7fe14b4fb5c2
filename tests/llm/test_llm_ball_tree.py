import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import ball_tree


def brute(rows, k, divisor):
    out = []
    good = [(i, np.floor(np.array(v, float) * 1024)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if q % divisor == 0:
            scored = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k, divisor, **how):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    v = df.select("vec_id", ball_tree.scaled(F.col("embedding")).alias("v"), "rank", "score")
    return sorted(tuple(r) for r in ball_tree.top_k(v, v.filter(F.col("vec_id") % divisor == 0), k, **how).collect())


def vectors(n, dims, seed, clusters=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    x = (centres[r.integers(0, clusters, n)] + r.normal(size=(n, dims)) * 0.2).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_exact_over_shards_and_blocks(spark):
    rows = vectors(1500, 8, 1)
    want = brute(rows, 10, 20)
    assert run(spark, rows, 10, 20) == want
    assert run(spark, rows, 10, 20, shard_rows=200, block_queries=20) == want


def test_ties_repeats_bad_vectors_and_lengths(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)]
    rows += [(100, None), (101, [None, 1.0]), (102, [float("nan"), 1.0]), (103, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    rows += [(200, []), (201, []), (210, [5.0]), (220, [1.0, 2.0, 3.0]), (221, [-1.0, 2.0, 3.0]), (7, [0.5, 0.5])]
    assert run(spark, rows, 4, 10) == brute(rows, 4, 10)
    assert run(spark, [*rows, (0, [0.0, 1.0])], 3, 10)[:3] == run(spark, rows, 3, 10)[:3]  # a repeated query answers once


def test_few_rows_empty_tables_and_overflow(spark):
    assert run(spark, [(0, [1.0]), (5, [2.0])], 10, 100) == [(0, 1, 5, 1024 * 2048)]
    assert run(spark, [], 10, 100) == []
    assert run(spark, [(1, [1.0])], 10, 100) == []
    with pytest.raises(OverflowError):
        run(spark, [(0, [1e30]), (1, [1e30])], 1, 1)


def test_scores_beyond_doubles_are_exact(spark):
    """Products of up to 2**62, which doubles round, and which cancel."""
    r = np.random.default_rng(9)
    wide = as_float([(i, r.integers(-(2**20), 2**20, 6) * 0.75) for i in range(300)])
    assert max(abs(s) for *_, s in whole_brute(wide, 5, 10)) > 2**53
    assert run(spark, wide, 5, 10, shard_rows=60) == whole_brute(wide, 5, 10)
    far = as_float([(i, [2.0**19, -(2.0**19) + i % 5, i / 1024]) for i in range(200)] + [(i, [2.0**19, 2.0**19, i / 1024]) for i in range(200, 400)])
    assert run(spark, far, 300, 100, shard_rows=60) == whole_brute(far, 300, 100)


def whole_brute(rows, k, divisor):
    """``brute`` in Python's integers; doubles round such scores."""
    good = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows]
    out = []
    for q, v in good:
        if q % divisor == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def as_float(rows):
    """Vectors as the table of floats holds them."""
    return [(i, [float(x) for x in np.array(v, np.float32)]) for i, v in rows]


def test_wide_vectors_are_split_by_components(spark, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_CELLS", 5000)
    rows = vectors(200, 128, 4)
    assert run(spark, rows, 3, 20) == brute(rows, 3, 20)


def test_bounds_prune_but_never_a_winner():
    rows = vectors(4000, 6, 3, 40)
    x = np.floor(np.array([v for _, v in rows]) * 1024)
    tree = ball_tree.Tree(x, np.arange(len(x)), 32)
    search = ball_tree.Search(x[:50], np.arange(50), 10, np.full(50, -np.inf))
    visited = []
    real = search.upper
    search.upper = lambda t, node, r: (visited.append(len(r)) if not t.left[node] else None, real(t, node, r))[1]
    search.visit(tree, 0, np.arange(50))
    leaves = sum(not n for n in tree.left)
    assert sum(visited) < 50 * leaves  # some leaves are never looked at
    for q in range(50):
        s = x @ x[q]
        assert search.scores[q].tolist() == sorted((s[i] for i in range(len(x)) if i != q), reverse=True)[:10]
