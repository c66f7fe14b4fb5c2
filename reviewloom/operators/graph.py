"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import materialise

#: Up to so many edges, one task finds the components at once: some MB, against several jobs for every round.
ONE_TASK = 1 << 18


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b reduced to one link from every node to the smallest of its component."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[x], parent[y])
        new = parent.copy()
        np.minimum.at(new, parent[x], low)
        np.minimum.at(new, parent[y], low)
        new = new[new]
        if np.array_equal(new, parent):
            break
        parent = new
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def stars_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: the links (a, b) of a task as stars."""
    links = (np.zeros(0, np.int64),) * 2
    for batch in batches:
        links = spanning_forest(*(np.append(old, batch.column(i).to_numpy()) for i, old in enumerate(links)))
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in links], ["node", "root"])


def components(edges: DataFrame, name: str = "stars", one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): the smallest node of each component of the graph of ``edges`` (a, b), but for the roots.

    Rounds of large-star and small-star steps; each round's edges are written to the shared folder, and
    the rounds end when a round changes nothing.  Up to ``one_task`` edges are joined in one task.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = state(edges)
    if before[0] <= one_task:
        stars = edges.filter("a is not null and b is not null").repartition(1).mapInArrow(stars_of_task, "node long, root long")
        return materialise(stars, name)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialise(large.filter("a <> b"), name)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        small = small.unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        edges = materialise(small, name)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
