"""Truncated SVD of sparse rows: a randomised range finder (Halko, Martinsson & Tropp 2011) and a tree of QR factors.

Only feature-sized matrices of ``dim + OVERSAMPLING`` columns and their small triangles are held anywhere; nothing is of
the size of features squared.  Partial results of tasks are summed by blocks of features, and triangles are merged in a
tree, so that no task and not the driver takes in one part for every other task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import giving_back, materialise

OVERSAMPLING = 10
POWER_ITERATIONS = 5
#: Relative change of all kept singular values below which further iterations are left out.
SETTLED = 1e-12
SEED = 20110500
CELLS = 1 << 23  # of a dense block of rows inside a task
CHUNK = 1024  # features in a block of a partial sum
FAN_IN = 16  # triangles merged by one task

Batches = Iterator[pa.RecordBatch]


def row_blocks(batch: pa.RecordBatch, n_features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a batch, some at a time: the features that occur in them, and the dense rows over those."""
    # a vector column travels as its sparse parts: index and value lists per row
    indices, values = (batch.column("tfidf").field(part) for part in ("indices", "values"))
    bounds = indices.offsets.to_numpy()
    index, value = indices.flatten().to_numpy(), values.flatten().to_numpy()
    step = max(1, min(CHUNK, CELLS // max(1, n_features)))
    for start in range(0, batch.num_rows, step):
        stop = min(start + step, batch.num_rows)
        inside = slice(bounds[start] - bounds[0], bounds[stop] - bounds[0])
        row = np.repeat(np.arange(stop - start), np.diff(bounds[start : stop + 1]))
        present, code = np.unique(index[inside], return_inverse=True)
        block = np.zeros((stop - start, len(present)))
        block[row, code] = value[inside]
        yield present, block


def _gram_times(vectors: DataFrame, axes: np.ndarray) -> np.ndarray:
    """A' A axes for the rows A, in one pass."""
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    width = axes.shape[1]

    def partial(batches: Batches) -> Batches:
        total = np.zeros(axes_shape)
        for batch in batches:
            for present, block in row_blocks(batch, axes_shape[0]):
                total[present] += block.T @ (block @ shared.value[present])
        starts = [s for s in range(0, axes_shape[0], CHUNK) if total[s : s + CHUNK].any()]
        for s in starts:
            part = pa.array([total[s : s + CHUNK].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), part], ["start", "part"])

    def summed(batches: Batches) -> Batches:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, part in zip(batch.column("start").to_pylist(), batch.column("part"), strict=True):
                part = np.frombuffer(part.as_buffer())
                totals[s] = totals[s] + part if s in totals else part.copy()
        for s, part in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["start", "part"])

    axes_shape = axes.shape
    parts = vectors.select("tfidf").mapInArrow(giving_back(partial), "start int, part binary")
    out = np.zeros(axes_shape)
    for r in parts.repartition("start").mapInArrow(giving_back(summed), "start int, part binary").collect():
        part = np.frombuffer(r.part).reshape(-1, width)
        out[r.start : r.start + len(part)] = part
    shared.destroy()
    return out


def _triangle(vectors: DataFrame, axes: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of A axes: a triangle for each task, then merged ``FAN_IN`` at a time."""
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    n, width = axes.shape

    def merged(blocks: Iterator[np.ndarray]) -> Batches:
        r, waiting, rows = np.zeros((0, width)), [], 0
        for block in blocks:
            waiting.append(block)
            rows += len(block)
            if rows >= 2 * width:
                r, waiting, rows = np.linalg.qr(np.concatenate([r, *waiting]), "r"), [], 0
        r = np.linalg.qr(np.concatenate([r, *waiting]), "r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["part"])

    def first(batches: Batches) -> Batches:
        return merged(block @ shared.value[present] for batch in batches for present, block in row_blocks(batch, n))

    def again(batches: Batches) -> Batches:
        return merged(np.frombuffer(part.as_buffer()).reshape(-1, width) for batch in batches for part in batch.column("part"))

    def level(df: DataFrame, run: Callable[[Batches], Batches]) -> DataFrame:
        return materialise(df.mapInArrow(giving_back(run), "part binary"), "triangles")

    parts = level(vectors.select("tfidf"), first)
    while (left := parts.count()) > FAN_IN:
        parts = level(parts.repartition(-(-left // FAN_IN), F.monotonically_increasing_id()), again)
    blocks = [np.frombuffer(r.part).reshape(-1, width) for r in parts.collect()]  # at most FAN_IN small triangles
    shared.destroy()
    return np.linalg.qr(np.concatenate([np.zeros((width, width)), *blocks]), "r")


def principal_axes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (features x at most ``dim``) of the sparse vectors ``tfidf``, uncentred, and
    their singular values.

    A seeded Gaussian sketch of ``dim + OVERSAMPLING`` columns is multiplied by A' A and made orthogonal again up to
    ``POWER_ITERATIONS`` times, one pass each, until the singular values stand still.  The triangle of A times that
    basis then gives the singular values and the turn of the basis.  If the sketch is as wide as the features, the basis
    is the identity and the result is the full decomposition.  Each axis has its largest component positive.  A table
    without rows has no axes.
    """
    one = vectors.select("tfidf").first()
    if one is None:
        return np.zeros((0, 0)), np.zeros(0)
    n = one.tfidf.size
    width = min(n, dim + OVERSAMPLING)
    basis = np.eye(n)
    if width < n:
        basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, width)))[0]
        before = np.zeros(dim)
        for _ in range(POWER_ITERATIONS):
            basis, r = np.linalg.qr(_gram_times(vectors, basis))
            found = np.sqrt(np.linalg.svd(r, compute_uv=False)[:dim])
            if np.abs(found - before).max(initial=0) <= SETTLED * found.max(initial=0):
                break
            before = found
    _, singular, turn = np.linalg.svd(_triangle(vectors, basis))
    keep = min(dim, width)
    axes = basis @ turn[:keep].T
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(keep)])
    return axes * np.where(signs == 0, 1.0, signs), singular[:keep]


def project(vectors: DataFrame, axes: np.ndarray) -> DataFrame:
    """``row_ix, vec``: the rows on the axes, in one row-wise pass."""
    shared = vectors.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            blocks = [block @ shared.value[present] for present, block in row_blocks(batch, len(shared.value))]
            out = np.concatenate([np.zeros((0, shared.value.shape[1])), *blocks])
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * out.shape[1]
            vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row_ix"), vec], names=["row_ix", "vec"])

    return vectors.select("row_ix", "tfidf").mapInArrow(run, "row_ix long, vec array<double>")
