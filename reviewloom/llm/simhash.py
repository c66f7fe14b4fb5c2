"""SimHash near duplicates by anchor-point covering.

A fingerprint is cut into ``blocks`` runs of bits.  Two fingerprints that differ in at most d bits differ
in at most d // blocks bits of some run.  In each run the anchors are a covering code: a perfect Hamming
code on its first 2**r - 1 bits times all values of the other bits, so every value is within one bit
(the covering radius) of exactly one anchor, its home.  A fingerprint goes to its home anchor, and to
every anchor within the covering radius plus d // blocks; a pair that links therefore meets at the home
of either.  Homes are compared with visitors anchor by anchor.

Exact copies collapse to one fingerprint first.  Anchors with very many fingerprints are dealt out as
tiles, so no task holds more than a tile's rows of one anchor, and what leaves a task is a spanning
forest of the links found, never all pairs.  Components of the forests are found by rounds of
minimum-label stars on written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.graph import components, spanning_forest
from reviewloom.session import giving_back, materialise

#: Homes and visitors of one anchor beyond this many rows are dealt out as tiles of about this size.
TILE_ROWS = 20_000
#: Pairs compared at once; bounds a task's memory.
PAIRS_AT_ONCE = 1 << 21


def shingle_hashes(text: bytes | None, size: int, seed: int) -> list[int]:
    """XXH64 of each run of ``size`` words; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split() if text else []
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes: the word whose bits are set in over half of them (0 for an empty run).

    Eight byte-wide counters share a 64-bit word, so runs are summed in pieces of at most 255.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(first, pieces)
    begins = np.repeat(np.cumsum(n) - n, pieces) + within * 255
    lanes = np.uint64(0x0101010101010101)
    word = np.zeros(len(full), np.uint64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & lanes, begins).view(np.uint8).reshape(-1, 8)
        for byte, total in enumerate(np.add.reduceat(sums.astype(np.int64), first, axis=0).T):
            word |= (2 * total > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[full] = word
    return out


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); a null or wordless text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t, size, seed) for t in batch.column("text").to_pylist()]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, counts.sum())
            fp = majority_bits(flat, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, fp long")


class Anchors:
    """The anchors of one run of bits: homes, and all anchors within ``radius`` of a value."""

    def __init__(self, low: int, width: int, within: int):
        self.low, self.mask = np.uint64(low), np.uint64((1 << width) - 1)
        self.checked = max(r for r in range(1, 17) if (1 << r) - 1 <= width)  # parity bits of the Hamming code
        self.coded = (1 << self.checked) - 1
        parity = np.zeros(1, np.uint8 if self.checked <= 8 else np.uint16)
        for bit in range(self.coded):
            parity = np.concatenate([parity, parity ^ (bit + 1)])
        self.parity = parity
        flips: list[list[int]] = [[] for _ in range(self.coded + 1)]
        for weight in range(1 + within + 1):
            for bits in combinations(range(width), weight):
                syndrome = 0
                for b in bits:
                    syndrome ^= b + 1 if b < self.coded else 0
                flips[syndrome].append(sum(1 << b for b in bits))
        self.flips = [np.array(f, np.uint64) for f in flips]

    def of(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, anchor, whether it is the row's home) in pieces, over all rows."""
        value = (fp >> self.low) & self.mask
        syndrome = self.parity[(value & np.uint64(len(self.parity) - 1)).astype(np.int64)].astype(np.int64)
        home = value ^ np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - 1).astype(np.uint64), np.uint64(0))
        rows = np.arange(len(fp))
        yield rows, home, np.ones(len(fp), bool)
        for s, flips in enumerate(self.flips):
            mine = rows[syndrome == s]
            yield np.repeat(mine, len(flips)), (value[mine, None] ^ flips).ravel(), np.zeros(len(mine) * len(flips), bool)


def block_anchors(blocks: int, distance: int, bits: int = 64) -> list[Anchors]:
    edges = [bits * i // blocks for i in range(blocks + 1)]
    if (distance // blocks) > 2 or max(np.diff(edges)) > 24:
        raise ValueError("use more blocks: tables of anchors within reach would be too large")
    return [Anchors(a, b - a, distance // blocks) for a, b in zip(edges, edges[1:], strict=False)]


def anchor_rows(fps: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(anchor, fp, home): each fingerprint at its home anchors and as a visitor at all anchors within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = block_anchors(blocks, distance)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for block, code in enumerate(codes):
                for rows, anchor, home in code.of(fp):
                    if len(rows):
                        key = (anchor | np.uint64(block << 32)).view(np.int64)
                        arrays = [pa.array(key), pa.array(fp[rows].view(np.int64)), pa.array(home)]
                        yield pa.RecordBatch.from_arrays(arrays, ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def linked(key: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and visitors of the same key; keys are sorted."""
    home_fp, home_key, visit_fp, visit_key = fp[home], key[home], fp[~home], key[~home]
    begin = np.searchsorted(visit_key, home_key, "left")
    count = np.searchsorted(visit_key, home_key, "right") - begin
    total = np.cumsum(count)
    found_a, found_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(home_fp):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
        n = count[at:to]
        visitor = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
        a, b = np.repeat(home_fp[at:to], n), visit_fp[visitor]
        near = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= distance)
        if near.any():
            found_a, found_b = spanning_forest(np.append(found_a, a[near]), np.append(found_b, b[near]))
        at = to
    return found_a, found_b


def links(fps: DataFrame, distance: int = 4, blocks: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b), a > b: per task a spanning forest of all links of at most ``distance`` bits between distinct ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in _with_end(batches):
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "home")]
                kept = new if kept is None else [np.concatenate(p) for p in zip(kept, new, strict=True)]
            if kept is None or not len(kept[0]):
                continue
            cut = len(kept[0]) if batch is None else int(np.searchsorted(kept[0], kept[0][-1]))
            if cut:
                a, b = linked(*(c[:cut] for c in kept), distance)
                kept = [c[cut:] for c in kept]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = anchor_rows(fps, blocks, distance)
    tiles = F.ceil(F.col("count") / tile_rows).cast("int")
    hot = materialise(rows.groupBy("anchor").count().filter(F.col("count") > tile_rows).select("anchor", tiles.alias("tiles")), "hot_anchors")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    other = F.col("other").cast("long")
    pair = F.when(F.col("home"), F.array(own, other)).otherwise(F.array(other, own))
    tiled = (
        rows.join(hot, "anchor", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(F.when(F.col("tiles") == 1, F.col("anchor")).otherwise(F.xxhash64("anchor", pair)).alias("key"), "fp", "home")
    )
    return tiled.repartition("key").sortWithinPartitions("key").mapInArrow(giving_back(run), "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, distance: int = 4, size: int = 4, seed: int = 42, blocks: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest doc_id reachable.
    Null and wordless texts have fingerprint 0 and link like any other.  Repeated rows and repeated ids are
    kept.  A null doc_id gets a row; it is never a component_id unless all ids of the component are null.
    An empty table gives an empty result.
    """
    marked = materialise(fingerprints(docs, size, seed), "fingerprints")
    fps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = components(links(fps, distance, blocks))
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    reach = materialise(nodes.join(fps, F.col("node") == F.col("fp")).select("fp", "root", "least"), "reach")
    joint = reach.select("fp", "root").join(reach.groupBy("root").agg(F.min("least").alias("joint")), "root").drop("root")
    classes = materialise(fps.join(joint, "fp", "left").select("fp", F.coalesce("joint", "least").alias("component_id")), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
