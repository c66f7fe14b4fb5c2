"""Approximate nearest neighbours by largest inner product, from a forest of random-projection trees.

Vectors are lengthened by one component so that all have the largest norm; near in angle is then near in inner
product.  A tree splits by the direction between two random rows, at the median.  Trees are fitted on a bounded
sample (``sample_rows``), one task a tree, and then every vector is put into one leaf of each tree.

A query walks all trees through one queue, ordered by the sum of squared margins by which it lies on the other
side of a leaf's splits, until the leaves it has taken hold ``budget`` rows.  The budget is measured, not guessed:
for ``tuning_queries`` vectors, and for each that a large part of the queries share, the true neighbours are found by
brute force, and the budget is the queue length within which the share ``recall`` of them is met, counted in rows: copies
of a query and of a neighbour count as often as they occur.  Where all vectors are far apart it is a large part of the rows, as for
any index of such vectors.

Leaves meet their queries in a join by leaf.  Both sides of a leaf are dealt out in tiles of bounded size, so neither
a leaf that the sample could not split nor one that all queries ask for is one task's work.  Scores are the inner
products of the original vectors, in double precision.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.session import giving_back, materialise

#: Rows of a leaf aimed at, and rows of the sample that a leaf has at least.
LEAF_ROWS, LEAST_SAMPLED = 1024, 16
#: Rows of a tile of a leaf's members or queries.
TILE_ROWS = 4096
#: Queries with one vector that are answered together.
COPIES_AT_ONCE = 10_000


@dataclass
class Tree:
    """Node i sends rows with x . plane[i] < at[i] to child[i], others to child[i] + 1; child 0 marks a leaf."""

    plane: np.ndarray
    at: np.ndarray
    child: np.ndarray
    leaf: np.ndarray  # number of the leaf among the tree's leaves
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # rows of each leaf

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(rows), np.int64)
        inner = np.flatnonzero(self.child[node] > 0)
        while len(inner):
            n = node[inner]
            right = np.einsum("ij,ij->i", rows[inner], self.plane[n]) >= self.at[n]
            node[inner] = self.child[n] + right
            inner = inner[self.child[node[inner]] > 0]
        return self.leaf[node]


def fit_tree(rows: np.ndarray, leaf_rows: float, seed: int) -> Tree:
    """A tree whose leaves have at most ``leaf_rows`` of ``rows``, but for equal ones."""
    r = np.random.default_rng(seed)
    plane, at, child, parts = [np.zeros(rows.shape[1])], [0.0], [0], [np.arange(len(rows))]
    i = 0
    while i < len(parts):
        mine = parts[i]
        if len(mine) > max(leaf_rows, 1):
            for _ in range(3):  # two rows may be equal
                a, b = rows[r.choice(mine, 2, replace=False)]
                length = np.linalg.norm(a - b)
                if length > 0:
                    break
            direction = (a - b) / (length or 1.0)
            shadow = rows[mine] @ direction
            middle = np.median(shadow)
            right = shadow >= middle
            if right.any() and not right.all():
                plane[i], at[i], child[i] = direction, middle, len(parts)
                parts += [mine[~right], mine[right]]
                plane += [plane[0] * 0, plane[0] * 0]
                at += [0.0, 0.0]
                child += [0, 0]
        i += 1
    child = np.array(child)
    return Tree(np.array(plane), np.array(at), child, np.cumsum(child == 0) - 1)


@dataclass
class Forest:
    """The trees of vectors of one length.  Cells are the leaves of all trees, numbered on from ``first``."""

    norm: float
    trees: list[Tree]
    first: int
    budget: int = 0

    def lengthened(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.norm**2 - (v * v).sum(axis=1), 0))])

    def cells(self, v: np.ndarray) -> np.ndarray:
        """The cell of each vector in each tree."""
        long = self.lengthened(v)
        base = self.first + np.cumsum([0] + [t.leaf[-1] + 1 for t in self.trees])
        return np.column_stack([t.place(long) + b for t, b in zip(self.trees, base, strict=False)])

    def walk(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """(cell, rows) in the order in which the shared queue gives leaves."""
        q = np.append(query * (self.norm / np.linalg.norm(query)), 0.0)
        base = self.first + np.cumsum([0] + [t.leaf[-1] + 1 for t in self.trees])
        margins = [t.plane @ q - t.at for t in self.trees]
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        while queue:
            away, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            child = int(tree.child[node])
            if not child:
                leaf = int(tree.leaf[node])
                yield int(base[t]) + leaf, int(tree.counts[leaf])
                continue
            m = float(margins[t][node])
            heapq.heappush(queue, (away + (m * m if m > 0 else 0.0), t, child))
            heapq.heappush(queue, (away + (m * m if m < 0 else 0.0), t, child + 1))


def _by_length(batch: pa.RecordBatch, name: str = "v") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length in a batch."""
    column = batch.column(name)
    edges = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(edges)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[edges[rows][:, None] + np.arange(d)].astype(np.float64)


def _fit(distinct: DataFrame, trees: int, leaf_rows: int, sample_rows: int, seed: int) -> dict[int, Forest]:
    """A forest for each length of vectors, without its leaves' counts."""
    lengths = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect()  # a row a length
    forests = {r.d: Forest(r.norm, [], 0) for r in lengths}
    total = {r.d: r.n for r in lengths}
    by_hash = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("v"), "v")
    sample = distinct.select("v", F.size("v").alias("d"), F.row_number().over(by_hash).alias("nth")).filter(F.col("nth") <= sample_rows)

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        d, tree = (k.as_py() for k in key)
        parts = [m for batch in table.combine_chunks().to_batches() for _, m in _by_length(batch)]
        rows = np.concatenate(parts)
        rows = rows[np.lexsort(rows.T)]  # however they came
        leaf = max(leaf_rows * len(rows) / total[d], min(LEAST_SAMPLED, leaf_rows))
        made = pickle.dumps(fit_tree(Forest(forests[d].norm, [], 0).lengthened(rows), leaf, seed * 1000 + tree))
        return pa.table({"d": pa.array([d], pa.int32()), "tree": pa.array([tree], pa.int32()), "made": pa.array([made], pa.binary())})

    each = materialise(sample, "sample").select("d", "v", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    grown = each.groupBy("d", "tree").applyInArrow(grow, "d int, tree int, made binary").collect()  # bounded by the sample
    first = 0
    for row in sorted(grown, key=lambda r: (r.d, r.tree)):
        forest = forests[row.d]
        forest.trees.append(pickle.loads(row.made))
        if len(forest.trees) == 1:
            forest.first = first
        first += int(forest.trees[-1].leaf[-1]) + 1
    return forests


def _placed(rows: DataFrame, forests, *keep: str) -> DataFrame:
    """``rows`` (v and others), once for each tree, with the ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, matrix in _by_length(batch):
                cells = forests.value[matrix.shape[1]].cells(matrix)
                some = batch.take(pa.array(rows))
                for cell in cells.T:
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), *(some.column(c) for c in keep)], ["cell", *keep])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(["cell long", *(f"{c} {kinds[c]}" for c in keep)]))


def _top(scores: np.ndarray, ids: list, k: int) -> tuple[list[int], list[float]]:
    """The k best (score, then smaller id) of rows that stand for several ids each."""
    floor = np.partition(scores, -k)[-k] if len(scores) > k else -np.inf
    near = np.flatnonzero(scores >= floor)
    pairs = sorted((-scores[i], x) for i in near.tolist() for x in ids[i])[:k]
    return [x for _, x in pairs], [float(-s) for s, _ in pairs]


def _products(matrix: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed the same way whatever else is in the matrix."""
    return (matrix * query).sum(axis=1)


def _brute(distinct: DataFrame, queries: list, k: int, dims: int) -> list[list[tuple[np.ndarray, int]]]:
    """For each of a few query vectors its ``k`` nearest rows, one of its own left out: (vector, rows with it), nearest
    first and ties by the smallest id, as in the result."""
    asked = np.array(queries, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in asked]
        for batch in batches:
            for rows, matrix in _by_length(batch) if batch.num_rows else ():
                if matrix.shape[1] != dims:
                    continue
                ids = batch.column("ids").take(pa.array(rows)).to_pylist()
                for q, rough in enumerate(asked @ matrix.T):
                    edge = np.partition(rough, -k - 1)[-k - 1] if len(rough) > k + 1 else -np.inf
                    near = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
                    scores = _products(matrix[near], asked[q]).tolist()
                    merged = best[q] + [(-s, ids[i][0], len(ids[i]), matrix[i]) for s, i in zip(scores, near.tolist(), strict=True)]
                    best[q] = sorted(merged, key=lambda p: p[:2])[: k + 1]
        found = [(q, -s, first, n, v.tolist()) for q, mine in enumerate(best) for s, first, n, v in mine]
        kinds = {"q": pa.int32(), "score": pa.float64(), "first": pa.int64(), "n": pa.int32(), "near": pa.list_(pa.float64())}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    found = distinct.select("v", "ids").mapInArrow(run, "q int, score double, first long, n int, near array<double>")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    found = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    out: list[list[tuple[np.ndarray, int]]] = [[] for _ in queries]
    for row in found.orderBy("q", "nth").collect():  # tuning queries times k + 1
        near = np.array(row.near)
        left = k - sum(n for _, n in out[row.q])
        n = min(row.n - np.array_equal(near, asked[row.q]), left)
        if n > 0:
            out[row.q].append((near, n))
    return out


def tuned_budget(forest: Forest, queries: list, nearest: list[list[np.ndarray]], recall: float, weights: list[list[float]] | None = None) -> int:
    """Rows that the queue must give for the share ``recall`` of true neighbours to be among them; a neighbour counts
    with its weight, 1 if there are none."""
    met = []
    for q, (query, true) in enumerate(zip(queries, nearest, strict=True)):
        if true:
            wanted = {}
            for i, cells in enumerate(forest.cells(np.array(true)).tolist()):
                for cell in cells:
                    wanted.setdefault(cell, []).append(i)
            left, seen = set(range(len(true))), 0
            for cell, rows in forest.walk(np.array(query, np.float64)):
                seen += rows
                for i in wanted.get(cell, ()):
                    if i in left:
                        left.discard(i)
                        met.append((seen, weights[q][i] if weights else 1.0))
                if not left:
                    break
    if not met:
        return 1
    met.sort()
    share = np.cumsum([weight for _, weight in met])
    return met[min(len(met) - 1, int(np.searchsorted(share, recall * share[-1], "right")))][0]


def _measured(asked: DataFrame, distinct: DataFrame, forest: Forest, k: int, dims: int, recall: float, tuning_queries: int) -> int:
    """The budget for the query rows of one length.  A vector that many of them share counts with their number and is
    always measured; of the others ``tuning_queries`` stand for the rest, chosen by another hash than the trees' sample."""
    asked = asked.filter(F.size("v") == dims).select("v", "copies")
    total = asked.agg(F.sum("copies")).first()[0]
    if not total:
        return 0
    many = F.col("copies") * tuning_queries > total
    hot = asked.filter(many).collect()  # fewer than tuning_queries
    some = asked.filter(~many).orderBy(F.xxhash64(F.lit(1), "v"), "v").limit(tuning_queries).collect()
    each = (total - sum(r.copies for r in hot)) / max(1, sum(r.copies for r in some))
    counts = [float(r.copies) for r in hot] + [r.copies * each for r in some]
    queries = [r.v for r in hot + some]
    near = _brute(distinct, queries, k, dims)
    weights = [[n * count for _, n in found] for found, count in zip(near, counts, strict=True)]
    return tuned_budget(forest, queries, [[v for v, _ in found] for found in near], recall, weights)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.95, trees: int = 4, leaf_rows: int = LEAF_ROWS,
    sample_rows: int = 1 << 15, tuning_queries: int = 128, tile_rows: int = TILE_ROWS, seed: int = 12,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of ``vectors`` found with the largest
    inner product; both are (vec_id, v) with v an array of floats or doubles, and other columns are ignored.

    A query is not matched with rows of its own vec_id; ties go to the smaller vec_id.  Rows with a null id, and vectors
    that are null, empty, zero or hold a null or non-finite component, take no part; vectors of different lengths do not
    match.  Copies of a vector count once in the index, with their smallest k + 1 ids, which are all that any query can
    return.  Repeated rows count once; of several vectors with one vec_id the best counts.  The queue always gives
    leaves with at least k + 1 vectors, so a query gets k rows wherever there are as many.  Empty tables give an empty
    result.
    """
    spark = vectors.sparkSession
    x = F.col("v").cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c))
    valid = vectors.select("vec_id", "v", norm.alias("norm")).filter("vec_id is not null and norm > 0 and norm < double('inf')")
    by_id = Window.partitionBy("v").orderBy("vec_id")
    few = valid.withColumn("nth", F.dense_rank().over(by_id)).filter(F.col("nth") <= k + 1)
    distinct = few.groupBy("v").agg(F.max("norm").alias("norm"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    distinct = materialise(distinct, "distinct_vectors")
    own = queries.select("vec_id", "v", norm.alias("norm")).filter("vec_id is not null and norm > 0 and norm < double('inf')").select("vec_id", "v")
    asked = materialise(own.groupBy("v").agg(F.min("vec_id").alias("query"), F.count("*").alias("copies")), "queries")

    forests = _fit(distinct, trees, leaf_rows, sample_rows, seed)
    shared = spark.sparkContext.broadcast(forests)  # trees fitted on bounded samples
    in_cell = dict(tuple(r) for r in _placed(distinct.select("v"), shared).groupBy("cell").count().collect())  # a row a leaf
    for forest in forests.values():
        at = forest.first
        for tree in forest.trees:
            n = int(tree.leaf[-1]) + 1
            tree.counts = np.array([in_cell.get(at + i, 0) for i in range(n)], np.int64)
            at += n
    for d, forest in forests.items():
        forest.budget = _measured(asked, distinct, forest, k, d, recall, tuning_queries)
    shared = spark.sparkContext.broadcast(forests)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _by_length(batch) if batch.num_rows else ():
                forest = shared.value.get(matrix.shape[1])
                row_of, cells = [], []
                for row, query in zip(rows.tolist(), matrix, strict=True) if forest else ():
                    seen, least = 0, min(forest.trees[0].counts.sum(), k + 1) * len(forest.trees)
                    for cell, n in forest.walk(query):
                        cells.append(cell)
                        row_of.append(row)
                        seen += n
                        if seen >= forest.budget and seen >= least:
                            break
                some = batch.take(pa.array(row_of, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), some.column("query"), some.column("v")], ["cell", "query", "v"])

    kind = dict(asked.dtypes)["v"]
    many = spark.sparkContext.defaultParallelism * 2
    visits = materialise(asked.select("query", "v").repartition(many).mapInArrow(visit, f"cell long, query long, v {kind}"), "visits")
    tiles = visits.groupBy("cell").count().collect()  # a row a leaf
    tiles = [(r["cell"], -(-in_cell.get(r["cell"], 0) // tile_rows), -(-r["count"] // tile_rows)) for r in tiles]
    tiles = F.broadcast(spark.createDataFrame(tiles, "cell long, members int, askers int"))  # a row a leaf: bounded by the sample
    members = _placed(distinct.select("v", "ids"), shared, "v", "ids").join(tiles, "cell")
    # both sides number their tiles as int: hashes of int and long differ, and equal tiles would lie in different partitions
    members = members.select("cell", F.pmod(F.xxhash64("v"), "members").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("j"), "v", "ids")
    askers = visits.join(tiles, "cell")
    askers = askers.select("cell", F.explode(F.sequence(F.lit(0), F.col("members") - 1)).alias("i"), F.pmod(F.xxhash64("query"), "askers").cast("int").alias("j"), "query", "v")

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            member, asker = left.combine_chunks().to_batches()[0], right.combine_chunks().to_batches()[0]
            ids = member.column("ids").to_pylist()
            ((_, matrix),), ((_, wanted),) = _by_length(member), _by_length(asker)
            for query, q, rough in zip(asker.column("query").to_pylist(), wanted, wanted @ matrix.T, strict=True):
                # the rough products only rule out rows that are surely not among the first k + 1
                edge = np.partition(rough, -k - 1)[-k - 1] if len(rough) > k + 1 else -np.inf
                near = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge)))
                best, scores = _top(_products(matrix[near], q), [ids[i] for i in near.tolist()], k + 1)
                found[0].append(query)
                found[1].append(best)
                found[2].append(scores)
        return pa.table({"query": pa.array(found[0], pa.int64()), "ids": pa.array(found[1], pa.list_(pa.int64())), "scores": pa.array(found[2], pa.list_(pa.float64()))})

    def merge(table: pa.Table) -> pa.Table:
        """All leaves' rows of one query: the queue's length bounds them."""
        best: dict[int, float] = {}
        for ids, scores in zip(table.column("ids").to_pylist(), table.column("scores").to_pylist(), strict=True):
            for i, s in zip(ids, scores, strict=True):
                best[i] = max(s, best.get(i, -np.inf))
        top = sorted(best.items(), key=lambda p: (-p[1], p[0]))[: k + 1]
        columns = {"query": table.column("query").slice(0, 1), "ids": pa.array([[i for i, _ in top]], pa.list_(pa.int64()))}
        return pa.table(columns | {"scores": pa.array([[s for _, s in top]], pa.list_(pa.float64()))})

    lists = "query long, ids array<long>, scores array<double>"
    by = ["cell", "i", "j"]
    leaves = members.groupBy(*by).cogroup(askers.groupBy(*by)).applyInArrow(score, lists)
    answers = materialise(leaves.groupBy("query").applyInArrow(merge, lists), "answers")
    return _each_query(own, asked, answers, k)


def _each_query(own: DataFrame, asked: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """The answers of distinct query vectors for each query; many copies of one are dealt out."""
    hot = materialise(asked.filter(F.col("copies") > COPIES_AT_ONCE).select("v", F.ceil(F.col("copies") / COPIES_AT_ONCE).alias("tiles")), "hot_queries")
    mine = own.distinct().join(hot, "v", "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64("vec_id"), "tiles"), F.lit(0)))
    last = F.coalesce(F.ceil(F.col("copies") / COPIES_AT_ONCE), F.lit(1)) - 1
    answers = asked.join(answers, "query").select("v", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("tile"), F.arrays_zip("ids", "scores").alias("found"))
    joined = mine.join(answers, ["v", "tile"]).select(F.col("vec_id").alias("query_id"), "found")
    others = F.slice(F.filter("found", lambda f: f["ids"] != F.col("query_id")), 1, k)
    ranked = joined.select("query_id", F.posexplode(others).alias("at", "f"))
    ranked = ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    return ranked
