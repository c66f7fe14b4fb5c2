"""Exact top-k inner products by branch and bound over ball trees, one tree a shard.

Vectors are dealt out to shards of bounded size, and each shard's tree is built in a task and written once.
Queries come in blocks of bounded size.  For each block one shard is searched first, whose k-th scores are
lower bounds that all other shards start from; within a shard the k-th score found so far prunes the rest.
A node's bound is q . centre + |q| * radius, and a query enters the child with the larger bound first.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.session import giving_back, materialise

#: Vectors in a shard, and queries in a block.
SHARD_ROWS = 1 << 15
BLOCK_QUERIES = 1 << 12
LEAF_ROWS = 256
#: Components in a shard (64 MB of doubles), whatever the width of the vectors.
SHARD_CELLS = 1 << 23
#: No score; less than every score.
NONE = np.iinfo(np.int64).min


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a double; null for a null vector or one with a component that
    is null or not finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * scale).cast("double")))


def by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vector: the places of those vectors, and the vectors as a matrix."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    found = {}
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        cells = flat if len(at) == len(sizes) else flat[begin[at][:, None] + np.arange(dims)]
        found[dims] = at, cells.reshape(len(at), dims)
    return found


def exact_products(queries: np.ndarray, vectors: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of whole-numbered rows as longs, where every product fits one.

    ``bound`` is the product of the greatest lengths, which no sum of absolute products exceeds: below 2**52 doubles hold
    all sums, else longs multiply.
    """
    if bound < 2.0**52:
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.T.astype(np.int64)


class Tree:
    """A ball tree as flat arrays: node i covers rows begin[i]:end[i]; children 0 means a leaf."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        begin, end, left = [0], [len(ids)], [0]
        at = 0
        while at < len(begin):
            b, e = begin[at], end[at]
            if e - b > leaf_rows:
                rows = vectors[order[b:e]]
                far = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
                away = rows[np.argmax(((rows - far) ** 2).sum(axis=1))]
                middle = b + (e - b) // 2
                order[b:e] = order[b:e][np.argpartition(rows @ (away - far), middle - b)]
                left[at] = len(begin)
                begin += [b, middle]
                end += [middle, e]
                left += [0, 0]
            at += 1
        self.vectors, self.ids = vectors[order], ids[order]
        self.begin, self.end, self.left = begin, end, left
        self.centres = np.array([self.vectors[b:e].mean(axis=0) if e > b else np.zeros(vectors.shape[1]) for b, e in zip(begin, end, strict=True)])
        gaps = [np.sqrt(((self.vectors[b:e] - c) ** 2).sum(axis=1).max(initial=0)) for b, e, c in zip(begin, end, self.centres, strict=True)]
        self.radii = np.array(gaps)
        self.longest = float(np.sqrt((vectors**2).sum(axis=1).max(initial=0)))
        self.reach = np.sqrt((self.centres**2).sum(axis=1)) + self.radii


class Search:
    """The best k of each query so far: scores and ids, best first; empty places score ``NONE``."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray):
        self.queries, self.own, self.k = queries, own, k
        self.bound = np.where(np.isfinite(bound), bound, NONE).astype(np.int64)
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.scores = np.full((len(queries), k), NONE)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def floor(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.bound[rows], self.scores[rows, -1])

    def upper(self, tree: Tree, node: int, rows: np.ndarray) -> np.ndarray:
        top = self.queries[rows] @ tree.centres[node] + self.norms[rows] * tree.radii[node]
        return top + 1e-9 * self.norms[rows] * tree.reach[node] + 1  # above any rounding; scores are whole numbers

    def visit(self, tree: Tree, node: int, rows: np.ndarray) -> None:
        rows = rows[self.upper(tree, node, rows) >= self.floor(rows)]
        if not len(rows):
            return
        left = tree.left[node]
        if left:
            first = self.upper(tree, left, rows) >= self.upper(tree, left + 1, rows)
            for mine, one, two in ((rows[first], left, left + 1), (rows[~first], left + 1, left)):
                if len(mine):
                    self.visit(tree, one, mine)
                    self.visit(tree, two, mine)
            return
        b, e = tree.begin[node], tree.end[node]
        scores = exact_products(self.queries[rows], tree.vectors[b:e], self.norms[rows].max() * tree.longest)
        scores[self.own[rows, None] == tree.ids[b:e]] = NONE
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(tree.ids[b:e], (len(rows), e - b))], axis=1)
        keep = np.lexsort((ids, ~scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, keep, axis=1)
        self.ids[rows] = np.take_along_axis(ids, keep, axis=1)


def build_shards(vectors: DataFrame, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(shard, dims, largest, tree): ball trees of ``vectors`` (vec_id, v), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # one shard: about shard_rows rows or SHARD_CELLS components at most
        if not parts:
            return
        ids = np.concatenate([p.column("vec_id").to_numpy() for p in parts])
        for dims, (at, matrix) in by_length(pa.concat_arrays([p.column("v") for p in parts])).items():
            tree = pickle.dumps(Tree(matrix, ids[at], leaf_rows))
            columns = [pa.array([dims], pa.int32()), pa.array([float(np.abs(matrix).max(initial=0))]), pa.array([tree], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["dims", "largest", "tree"])

    rows, cells = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-rows // shard_rows), -(-cells // SHARD_CELLS))
    dealt = vectors.repartition(shards, F.xxhash64("vec_id", "v"))
    trees = dealt.mapInArrow(giving_back(run), "dims int, largest double, tree binary")
    return materialise(trees.withColumn("shard", F.monotonically_increasing_id()), "ball_trees")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the highest inner product with each
    row of ``queries``; both are (vec_id, v) with v whole-numbered doubles (``scaled``).

    A query is not matched with rows of its own vec_id.  Ties go to the smaller vec_id.  Rows with a null id or
    a null v take no part; vectors of different lengths do not match.  Repeated queries with equal id and
    vector answer once; repeated candidates are candidates each.  Scores are exact, beyond 2**53 too; a corpus
    whose scores could leave the longs of the result (components x largest squared from 2**63) is an error.  Further columns, of whatever names, are left out.  Empty
    tables give an empty result.
    """
    spark = vectors.sparkSession
    valid = materialise(vectors.filter("vec_id is not null and v is not null").select("vec_id", "v"), "vectors")
    asked = queries.filter("vec_id is not null and v is not null").select("vec_id", "v").distinct()
    asked = materialise(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    trees = build_shards(valid, shard_rows)
    for dims, largest in trees.groupBy("dims").agg(F.max("largest")).collect():  # a row for each length
        if dims * largest * largest >= 2.0**63:
            raise OverflowError(f"scores of vectors of {dims} components up to {largest} may not fit a long")
    schema = "query long, query_id long, vec_id long, score long"
    blocks = max(1, -(-asked.count() // block_queries))
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()
        keys, own = rows.column("query").to_numpy(), rows.column("vec_id").to_numpy()
        asked_by_length = by_length(rows.column("v").combine_chunks()) if rows.num_rows else {}
        shared = spark.sparkContext.broadcast((keys, own, asked_by_length, k))
        first = _searched(trees.filter("shard = 0"), shared, None, schema)
        kth = Window.partitionBy("query").orderBy(F.desc("score"))
        lower = materialise(first, "first_shard")
        bounds = lower.withColumn("n", F.row_number().over(kth)).filter(F.col("n") == k).select("query", "score").collect()
        bound = spark.sparkContext.broadcast(dict(tuple(b) for b in bounds))  # a row for each query of the block
        rest = _searched(trees.filter("shard <> 0"), shared, bound, schema)
        part = lower.unionByName(rest)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(trees: DataFrame, shared, bound, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, asked_by_length, k = shared.value
        lower = bound.value if bound else {}
        floor = np.array([lower.get(q, NONE) for q in keys.tolist()], np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                mine, asked = asked_by_length.get(batch.column("dims")[i].as_py(), ((), None))
                if not len(mine):
                    continue
                tree: Tree = pickle.loads(batch.column("tree")[i].as_buffer())
                search = Search(asked, own[mine], k, floor[mine])
                search.visit(tree, 0, np.arange(len(mine)))
                floor[mine] = search.floor(np.arange(len(mine)))  # the next shard of this task starts from it
                query, place = np.nonzero((search.scores != NONE) & (search.scores >= search.bound[:, None]))
                arrays = [keys[mine][query], own[mine][query], search.ids[query, place], search.scores[query, place]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query", "query_id", "vec_id", "score"])

    return trees.select("dims", "tree").mapInArrow(giving_back(run), schema)
