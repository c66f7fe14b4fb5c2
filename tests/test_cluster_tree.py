"""The hierarchy of density clusters against a plain one that unites all pairs in order."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import cluster_tree as ct
from reviewloom.operators import topics_cluster as tc
from reviewloom.operators import vector_blocks as vb
from reviewloom.operators.graph import components
from reviewloom.session import shared_folder


def vectors(spark, points, partitions=4):
    rows = [(i, None if p is None else [None if x is None else float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "row_ix long, vec array<double>").repartition(partitions)


def found(df):
    return [r.cluster_id for r in df.orderBy("row_ix").collect()]


def plain_hierarchy(points, min_pts, min_size):
    """Rows united at one weight after the other, all pairs listed; clusters carry rows with their inverse weights."""
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    gap = np.sqrt(np.maximum(2 - 2 * unit @ unit.T, 0))
    np.fill_diagonal(gap, 0)
    gap = np.maximum(np.round(gap, 7), 1e-6)
    core = np.sort(gap, axis=1)[:, min_pts - 1]
    far = np.maximum(np.maximum(core[:, None], core), gap)
    n = len(points)
    # Prim's tree
    best, frm, inside, edges, at = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), [], 0
    for _ in range(n - 1):
        inside[at] = True
        near = far[at] < best
        best[near], frm[near] = far[at][near], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], int(frm[at]), at))
    part, members = list(range(n)), {i: [i] for i in range(n)}
    cluster = {}  # part -> number
    held, born, above, children = [], [], [], []  # rows with inverse weights, weight of birth, parent, children
    for weight in sorted({e[0] for e in edges}):
        groups = {}
        links = [(part[a], part[b]) for w, a, b in edges if w == weight]
        for a, b in links:
            new = groups.get(a, {a}) | groups.get(b, {b})
            for x in new:
                groups[x] = new
        for group in {id(g): sorted(g) for g in groups.values()}.values():
            large = [p for p in group if p in cluster]
            loose = [r for p in group if p not in cluster for r in members[p]]
            rows = [r for p in group for r in members[p]]
            if len(large) == 1:
                number = cluster[large[0]]
                held[number] += [(r, 1 / weight) for r in loose]
            elif len(large) > 1 or len(rows) >= min_size:
                number = len(held)
                held.append([(r, 1 / weight) for r in loose])
                born.append(np.inf)
                above.append(None)
                children.append([cluster[p] for p in large])
                for c in children[-1]:
                    above[c], born[c] = number, weight
                held[number] += [(r, 1 / weight, "child") for p in large for r in members[p]]
            else:
                number = None
            for p in group:
                cluster.pop(p, None)
                members.pop(p)
            members[group[0]] = rows
            for r in rows:
                part[r] = group[0]
            if number is not None:
                cluster[group[0]] = number
    stable, chosen = [], []
    for c in range(len(held)):  # children come before parents
        own, below = sum(h[1] - 1 / born[c] for h in held[c]), sum(stable[x] for x in children[c])
        chosen.append(above[c] is not None and own >= below)
        stable.append(max(own, below))
    label = [-1] * n
    for c in reversed(range(len(held))):
        if chosen[c]:
            for x in _under(c, children):
                chosen[x] = False
            for x in [c, *_under(c, children)]:
                for h in held[x]:
                    label[h[0]] = c if len(h) == 2 else label[h[0]]
    order = sorted(set(label) - {-1}, key=lambda c: (-label.count(c), label.index(c)))
    return [order.index(c) if c >= 0 else -1 for c in label]


def _under(c, children):
    return [y for x in children[c] for y in (x, *_under(x, children))]


def three_densities(rng, sizes=(500, 500, 500), noise=500):
    """Clusters of three densities: two tight ones side by side, nearer to each other than rows of the widest are."""
    tight = [np.array([1.0, 0, 0, 0, 0, 0]), np.array([1.0, 0.16, 0, 0, 0, 0])]
    parts = [c + rng.normal(size=(sizes[0] // 2, 6)) * 0.01 for c in tight]
    parts.append(np.array([0, 0, 1.0, 0, 0, 0]) + rng.normal(size=(sizes[1], 6)) * 0.05)
    parts.append(np.array([0, 0, 0, 0, -1.0, 0]) + rng.normal(size=(sizes[2], 6)) * 0.2)
    parts.append(rng.normal(size=(noise, 6)))
    return np.concatenate(parts)


def test_three_densities_equal_the_plain_hierarchy_whatever_the_partitions(spark):
    points = three_densities(np.random.default_rng(1))
    expected = plain_hierarchy(points, 5, 40)
    assert len(points) == 2000
    assert found(tc.hierarchical_clusters(vectors(spark, points, 2), 5, 40)) == expected
    assert found(tc.hierarchical_clusters(vectors(spark, points, 7), 5, 40)) == expected
    # each planted cluster is one cluster
    homes = [expected[a:b] for a, b in ((0, 250), (250, 500), (500, 1000), (1000, 1500))]
    common = [max(set(h) - {-1}, key=h.count) for h in homes]
    assert len(set(common)) == 4 and all(h.count(c) > 0.6 * len(h) for h, c in zip(homes, common))


def test_ties_copies_and_rows_without_direction(spark):
    rng = np.random.default_rng(3)
    square = np.array([[1, 0.1 * x, 0.1 * y] for x in range(4) for y in range(4)], float)
    points = np.concatenate([square, square[:6], square @ np.diag([-1, 1, 1]), np.repeat([[0.0, 0, 1]], 9, axis=0), rng.normal(size=(12, 3))])
    for min_pts, min_size in ((1, 2), (3, 5), (4, 9), (5, 40)):
        expected = plain_hierarchy(points, min_pts, min_size)
        odd = [*points.tolist(), None, [0.0, 0.0, 0.0], [None, 1.0, 0.0], [float("nan"), 0.0, 1.0]]
        assert found(tc.hierarchical_clusters(vectors(spark, odd, 3), min_pts, min_size)) == expected + [-1] * 4, (min_pts, min_size)


def test_nothing_to_cluster(spark):
    assert found(tc.hierarchical_clusters(vectors(spark, []), 3, 5)) == []
    assert found(tc.hierarchical_clusters(vectors(spark, [[1.0, 0.0]] * 7), 3, 5)) == [-1] * 7
    assert found(tc.hierarchical_clusters(vectors(spark, [[1.0, 0.0], [0.0, 1.0]]), 3, 5)) == [-1] * 2
    with pytest.raises(ValueError):
        tc.hierarchical_clusters(vectors(spark, []), 3, 1)


def test_minimum_forest():
    rng = np.random.default_rng(5)
    a, b, w = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 9, 300) / 4
    x, y, v = ct.minimum_forest(a, b, w)
    part, expected = list(range(40)), []
    for weight, p, q in sorted(zip(w.tolist(), np.minimum(a, b).tolist(), np.maximum(a, b).tolist())):
        if part[p] != part[q]:
            expected.append((weight, p, q))
            part = [part[p] if c == part[q] else c for c in part]
    assert list(zip(v.tolist(), x.tolist(), y.tolist())) == expected
    assert [len(c) for c in ct.minimum_forest(a[:0], b[:0], w[:0])] == [0, 0, 0]


def test_growing_links_are_the_minimum_forest():
    """Links that come matrix by matrix, useless ones left out, against the forest of them all."""
    rng = np.random.default_rng(11)
    for places in (1, 3):  # many equal weights, few
        links, every = ct.Links(), []
        for _ in range(40):
            x, y = np.sort(rng.choice(30, 6, False)), np.sort(30 + rng.choice(50, 9, False))
            w = np.round(rng.random((6, 9)), places) + 0.1
            i, j = np.nonzero(links.useful(w, x))
            links.add(x[i], y[j], w[i, j])
            if rng.random() < 0.4:
                links.joined()
            i, j = np.nonzero(w)
            every.append((x[i], y[j], w[i, j]))
        expected = ct.minimum_forest(*(np.concatenate(c) for c in zip(*every, strict=True)))
        a, b, w = links.joined()
        assert [c.tolist() for c in (a, b, w)] == [c.tolist() for c in expected]
        direct = links.known(int(a[0]), np.array([b[0], 1000]), 9.0)
        assert direct[0] == w[0] and direct[1] == 9.0


def test_no_vector_in_reach_is_missed_by_half_the_digits():
    rng = np.random.default_rng(12)
    for dims in (2, 64, 400):
        unit = rng.normal(size=(300, dims))
        unit[150:] = unit[:150] + rng.normal(size=(150, dims)) * 1e-4
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        gap = ct._distances(unit, unit)
        for most in (1e-6, 1e-4, *np.quantile(gap, [0.01, 0.3, 0.9])):
            near = ct.in_reach(unit, unit, np.array(most))
            assert near[gap <= most].all() and not near[gap > most + 0.02].any()


def test_passes_of_the_hierarchy_shuffle_no_vectors(spark):
    points = np.random.default_rng(13).normal(size=(400, 6))
    rows = tc._directions(vectors(spark, points)).select(F.col("row_ix").alias("id"), F.lit(1).cast("long").alias("n"), "unit")
    index = vb.build_index(rows, len(points), 32, 2.0, 64)
    wanted = index.blocks.select(F.col("home").alias("want")).distinct()
    cores = ct._core_distances(index, 2.0, 5, wanted, None)
    assert "Exchange" not in cores._jdf.queryExecution().executedPlan().toString()
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    expected = np.sort(ct._distances(unit, unit), axis=1)[:, 4]
    found = {r.id: r.core for r in cores.collect()}
    assert np.allclose([found[i] for i in range(400)], expected, atol=1e-6)


def test_few_edges_are_joined_in_one_task(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (60, 60)], "a long, b long")
    written, one, rounds = [], None, None
    for limit in (100, 0):
        before = set(os.listdir(shared_folder(spark)))
        found = sorted(map(tuple, components(edges, one_task=limit).collect()))
        one, rounds = rounds, found
        written.append(len(set(os.listdir(shared_folder(spark))) - before))
    assert one == rounds == sorted([(i, 0) for i in range(1, 31)] + [(41, 40), (50, 40)])
    assert written[0] == 2 < written[1]
