"""An index of vectors by balls, and joins of vectors with all vectors in reach.

Vectors are dealt to their nearest pivots and, by distance from it, to rings: a cell is a ring of a pivot.  Pivots
are rows of a bounded sample, no two within reach of each other.  The vectors of a cell are cut into blocks of bounded
size, each with the ball around it.  Neighbouring blocks form groups, the unit of work.  A group asks for the cells
that can hold vectors in reach of one of its balls, which a bounded table of pivots and rings decides, and its task
reads the blocks of just those cells from the shared folder, some at a time.  Where clusters are apart, a group reads
a few cells, however many there are.  Blocks are written once and never shuffled: where all vectors are far apart each
group reads them all, and what would be copies for every group stays off the disks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import SMALL_GROUPS, shared_table, write_table

#: Vectors to a pivot aimed at, the most pivots there are, and rows of the sample; with more vectors, cells grow.
PIVOT_ROWS, MOST_PIVOTS, SAMPLE_ROWS = 32, 4096, 1 << 15
LEAST_PIVOTS = 32
#: Rings of a pivot, each as wide as the reach but for the last.
RINGS = 8
#: Vectors in a group of blocks, and vectors compared with a group at once.
GROUP_ROWS, CHUNK_ROWS = 8192, 4096
#: Above any rounding of distances between unit vectors.
SLACK = 1e-9

_BLOCK = "block long, home long, cell long, ids binary, n binary, unit binary, centre array<double>, radius double, near double, far double"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class BlockIndex:
    """Blocks, their path and groups, the pivots of their cells, and the least and largest distance of each cell's vectors
    from its pivot (-1 for a cell without any); cell p * RINGS + r is ring r of pivot p."""

    blocks: DataFrame
    path: str
    homes: np.ndarray
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray


def gaps(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows and pivots.  Squares lose half of the digits: near zero they are known to about 1e-7."""
    return np.sqrt(np.maximum((rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T, 0))


def in_reach(rows: np.ndarray, others: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether unit vectors can be within ``most`` of each other, by products of half the digits, with more than their
    error added: none in reach is missed, and of others only those just beyond."""
    close = rows.astype(np.float32) @ others.astype(np.float32).T
    least = 1 - np.square(most + 1e-6) / 2 - 1e-6 - 4e-7 * rows.shape[1]
    return close >= least.astype(np.float32)


def spread_pivots(sample: np.ndarray, most: int, apart: float) -> np.ndarray:
    """Rows of ``sample``, in its order, that are no nearer than ``apart`` to an earlier one, at most ``most``; of a
    sample mostly of rows without neighbours, the first and those with neighbours.  They shape cells, not results."""
    pivots = sample[:1]
    for a in range(1, len(sample), 256):
        some = sample[a : a + 256]
        some = some[(gaps(some, pivots) >= apart).all(axis=1)]
        near = gaps(some, some) < apart
        kept: list[int] = []
        for i in range(len(some)):
            if not near[i, kept].any():
                kept.append(i)
        pivots = np.concatenate([pivots, some[kept]])[:most]
        if len(pivots) == most:
            break
    near = sum((gaps(sample[a : a + 256], pivots) < apart).sum(axis=0) for a in range(0, len(sample), 256))
    if near[near > 1].sum() >= len(sample) / 2:
        return pivots
    # mostly vectors without neighbours: their cells would be many and all in reach of each other
    return pivots[(near > 1) | (np.arange(len(pivots)) < LEAST_PIVOTS)]


def build_index(points: DataFrame, n_points: int, block_rows: int, eps: float, group_rows: int = GROUP_ROWS) -> BlockIndex:
    """The index of ``points`` (id, n, unit) for reaches of ``eps``, written to the shared folder."""
    spark = points.sparkSession
    some = points.select(F.xxhash64("unit").alias("h"), "id", "unit").orderBy("h", "id").limit(min(SAMPLE_ROWS, max(256, n_points // 8)))
    pivots = spread_pivots(matrix(some.select("unit").toArrow().combine_chunks().column("unit").chunk(0)), min(MOST_PIVOTS, max(16, n_points // PIVOT_ROWS)), eps)
    shared = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = matrix(batch.column("unit"))
                cell = np.empty(len(unit), np.int64)
                for i in range(0, len(unit), 1024):
                    gap = gaps(unit[i : i + 1024], shared.value)
                    near = gap.argmin(axis=1)
                    ring = np.minimum(gap[np.arange(len(near)), near] / eps, RINGS - 1).astype(np.int64)
                    cell[i : i + 1024] = near * RINGS + ring
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "n", "unit", "cell"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, home, held = TaskContext.get().partitionId() << 32, None, 0
        left: list[np.ndarray] | None = None
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = [batch.column("cell").to_numpy(), batch.column("id").to_numpy(), batch.column("n").to_numpy(), matrix(batch.column("unit"))]
                left = new if left is None else [np.concatenate(p) for p in zip(left, new, strict=True)]
            if left is None:
                return
            starts = np.append(np.flatnonzero(np.diff(left[0], prepend=-1)), len(left[0]))
            rows = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if batch is not None and b == len(left[0]):
                    break  # the cell may go on
                for x in range(a, b, block_rows):
                    y = min(x + block_rows, b)
                    if home is None or held >= group_rows:
                        home, held = number, 0
                    rows.append(_block(number, home, *(c[x:y] for c in left), shared.value))
                    number, held = number + 1, held + y - x
                    if len(rows) * block_rows >= group_rows:
                        yield _record(rows)
                        rows = []
            else:
                a = len(left[0])
            left = [c[a:] for c in left]
            if rows:
                yield _record(rows)

    placed = points.mapInArrow(place, "id long, n long, unit array<double>, cell long")
    sorted_ = placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    path = write_table(sorted_.select("id", "n", "unit", "cell").mapInArrow(cut, _BLOCK), "blocks", **SMALL_GROUPS)
    blocks = spark.read.schema(_BLOCK).parquet(path)
    low, high = np.full((2, len(pivots) * RINGS), -1.0)
    for cell, near, far in blocks.groupBy("cell").agg(F.min("near"), F.max("far")).collect():  # at most a row for each ring of a pivot
        low[cell], high[cell] = near, far
    homes = np.array(sorted(r.home for r in blocks.select("home").distinct().collect()), np.int64)  # a row for each group
    return BlockIndex(blocks, path, homes, pivots, low, high)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _block(number: int, home: int, cell: np.ndarray, ids: np.ndarray, n: np.ndarray, unit: np.ndarray, pivots: np.ndarray) -> tuple:
    centre = unit.mean(axis=0)
    radius = float(np.sqrt(((unit - centre) ** 2).sum(axis=1).max()))
    gap = np.sqrt(((unit - pivots[cell[0] // RINGS]) ** 2).sum(axis=1))
    return number, home, int(cell[0]), ids.astype("<i8").tobytes(), n.astype("<i8").tobytes(), unit.astype("<f8").tobytes(), centre.tolist(), radius, float(gap.min()), float(gap.max())


def _record(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.list_(pa.float64())] + [pa.float64()] * 3
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class Rows:
    """Vectors of some blocks: ids, n, unit, the block of each, and the columns that a join added to the blocks."""

    def __init__(self, blocks: list[dict]):
        self.blocks = blocks
        self.ids = np.concatenate([np.frombuffer(b["ids"], "<i8") for b in blocks])
        self.n = np.concatenate([np.frombuffer(b["n"], "<i8") for b in blocks])
        sizes = [len(b["ids"]) // 8 for b in blocks]
        self.unit = np.concatenate([np.frombuffer(b["unit"], "<f8").reshape(s, -1) for b, s in zip(blocks, sizes, strict=True)])
        self.bounds = np.append(0, np.cumsum(sizes))
        self.centre, self.radius = np.array([b["centre"] for b in blocks]), np.array([b["radius"] for b in blocks])
        self.home = np.repeat([b["home"] for b in blocks], sizes)

    def per_row(self, name: str, kind: str) -> np.ndarray:
        return np.concatenate([np.frombuffer(b[name], kind) for b in self.blocks])

    def slice(self, a: int, b: int) -> Rows:
        return Rows(self.blocks[a:b])


def _asked(centre: np.ndarray, radius: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, eps: float) -> np.ndarray:
    """The cells that can hold vectors within ``eps`` of one of the balls, in order."""
    low, high = low.reshape(-1, RINGS), high.reshape(-1, RINGS)
    asked = np.zeros(low.shape, bool)
    for a in range(0, len(centre), 64):
        gap, most = gaps(centre[a : a + 64], pivots)[:, :, None], radius[a : a + 64, None, None] + eps + 1e-6
        asked |= ((gap <= most + high) & (gap >= low - most) & (high >= 0)).any(axis=0)
    return np.flatnonzero(asked)


def asked_cells(index: BlockIndex, eps: float) -> DataFrame:
    """(want, cell): the cells that can hold vectors within ``eps`` of a vector of group ``want``."""
    shared = index.blocks.sparkSession.sparkContext.broadcast((index.pivots, index.low, index.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column("home").to_numpy()
            for want in np.unique(home):
                some = batch.filter(pa.array(home == want))
                cells = _asked(matrix(some.column("centre")), some.column("radius").to_numpy(), *shared.value, eps)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), want)), pa.array(cells)], ["want", "cell"])

    return index.blocks.select("home", "centre", "radius").mapInArrow(run, "want long, cell long").distinct()


def over_reach(index: BlockIndex, eps: float, schema: str, begin: Callable, meet: Callable, end: Callable, extra: DataFrame | None = None, needed: Callable | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Every group of vectors against all vectors of blocks within ``eps`` of it.

    ``begin(own)`` makes a group's state from its ``Rows``, ``meet(state, at, strip, others)`` takes rows at: of it with
    others in reach, and ``end(state, own)`` gives the group's record batch.  ``extra`` adds columns to blocks by
    ``block``; ``needed(block)`` tells the blocks that are looked at where they are no group's own; ``wanted`` (want)
    names the groups, else all.
    """
    spark = index.blocks.sparkSession
    marks = None if extra is None else write_table(extra.repartitionByRange("block").sortWithinPartitions("block"), "marks", **SMALL_GROUPS)
    homes = index.homes if wanted is None else np.array(sorted(r.want for r in wanted.collect()), np.int64)  # a row for each group
    shared, path = spark.sparkContext.broadcast((homes, index.pivots, index.low, index.high)), index.path

    def strips(own: Rows) -> list[tuple[int, Rows]]:
        """Runs of blocks of about a thousand vectors, with the place of their first."""
        out, a = [], 0
        for b in range(1, len(own.blocks) + 1):
            if b == len(own.blocks) or own.bounds[b + 1] - own.bounds[a] > 1024:
                out.append((int(own.bounds[a]), own.slice(a, b)))
                a = b
        return out

    def compare(state, parts: list[tuple[int, Rows]], chunk: list[dict]) -> None:
        centre, radius = np.array([b["centre"] for b in chunk]), np.array([b["radius"] for b in chunk])
        for at, strip in parts:
            near = np.zeros(len(chunk), bool)
            for c, r in zip(strip.centre, strip.radius, strict=True):
                near |= np.sqrt(((centre - c) ** 2).sum(axis=1)) <= radius + r + eps + SLACK
            some = [chunk[i] for i in np.flatnonzero(near)]
            if some:
                meet(state, at, strip, Rows(some))

    def marked(blocks: list[dict]) -> list[dict]:
        if marks is None:
            return blocks
        found = {r["block"]: r for r in shared_table(marks).rows("block", np.array(sorted(b["block"] for b in blocks)))}
        return [b | found[b["block"]] for b in blocks if b["block"] in found]

    def others(want: int, own: Rows) -> Iterator[list[dict]]:
        """The other groups' blocks in reach, some thousand vectors at a time."""
        chunk, held = [], 0
        for row in shared_table(path).rows("cell", _asked(own.centre, own.radius, *shared.value[1:], eps)):
            if row["home"] != want:
                chunk.append(row)
                held += len(row["ids"]) // 8
            if held >= CHUNK_ROWS:
                yield marked(chunk)
                chunk, held = [], 0
        if chunk:
            yield marked(chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for want in shared.value[0][batch.column("id").to_numpy()].tolist():
                mine = marked(sorted(shared_table(path).rows("home", np.array([want])), key=lambda b: b["block"]))
                own = Rows(mine)
                state, parts = begin(own), strips(own)
                for a in range(0, len(mine), 16):
                    compare(state, parts, mine[a : a + 16])
                for chunk in others(want, own):
                    chunk = [b for b in chunk if needed is None or needed(b)]
                    if chunk:
                        compare(state, parts, chunk)
                yield end(state, own)

    # a task for each group
    return spark.range(0, len(homes), 1, max(1, len(homes))).mapInArrow(run, schema)
