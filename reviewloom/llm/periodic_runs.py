"""Periodic runs of words, by difference-cover longest common extensions on a harmonic grid.

A run is a maximal stretch of words with smallest period p that is at least ``min_length`` words and
``min_exponent`` periods long.  Whatever its place, it holds a pair of words (i, i + p) with i on a grid of step
max(min_length - p, (min_exponent - 1) * p): the steps grow with the periods, so there are n log n pairs for n
words.  How far the words agree from such a pair on, forwards and backwards, gives the run.

Longest common extensions sort only the suffixes at a difference cover, 6 of any 31 neighbouring places: for any
i and j some shift under 31 brings both onto the cover, so a few words are compared and the rest is the minimum of
common prefixes between two ranks, read off a sparse table.

Texts are handled in groups of bounded size inside tasks; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.session import giving_back

#: A perfect difference set modulo 31 (fixed values): every other remainder is a difference of two of them.
COVER, MODULUS = (0, 1, 3, 8, 12, 18), 31
#: Text handled at once, in bytes; a longer text is a group of its own.
BYTES_AT_ONCE = 1 << 20
#: Pairs of the grid looked at together.
PAIRS_AT_ONCE = 1 << 20

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def _shifts() -> np.ndarray:
    """shift[i, j]: the least d that brings both remainders i and j into the cover."""
    place = np.arange(MODULUS)
    both = _IN_COVER[(place[:, None, None] + place) % MODULUS] & _IN_COVER[(place[:, None] + place) % MODULUS]
    return both.argmax(axis=2)


_SHIFT = _shifts()


class SampledSuffixes:
    """Longest common extensions to the right in ``words``, whose last entry occurs nowhere else."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.full(MODULUS, words[-1])])
        at = np.flatnonzero(_IN_COVER[np.arange(n) % MODULUS])
        at = np.append(at, n - 1) if not len(at) or at[-1] != n - 1 else at  # a short text may have no other
        blocks = np.ascontiguousarray(self.words[at[:, None] + np.arange(MODULUS)].astype("<i4"))
        rank = np.unique(blocks.view(f"V{4 * MODULUS}").ravel(), return_inverse=True)[1]
        self.index = np.full(n + MODULUS, -1, np.int64)
        self.index[at] = np.arange(len(at))
        levels, length = [rank], MODULUS
        while rank.max() + 1 < len(at):  # twice the length a round, at places with the same remainder
            rank = np.unique(rank * (len(at) + 1) + 1 + self._level(rank, at + length), return_inverse=True)[1]
            levels.append(rank)
            length *= 2
        self.rank = rank
        order = np.argsort(rank)
        table = [self._neighbours(levels, at[order[:-1]], at[order[1:]])]
        while 2 << len(table) - 1 <= len(order) - 1:
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def _level(self, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks at places, -1 behind the end."""
        index = self.index[np.minimum(at, len(self.index) - 1)]
        return np.where(index >= 0, rank[index], -1)

    def _neighbours(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes a and b: whole blocks by the ranks, the rest word by word."""
        found = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            x, y = self._level(levels[level], a + found), self._level(levels[level], b + found)
            found += np.where((x == y) & (x >= 0), MODULUS << level, 0)
        return found + self._agree(a + found, b + found, np.full(len(a), MODULUS))

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from a and b on, at most ``most``."""
        found = np.zeros(len(a), np.int64)
        rows = np.arange(len(a))
        for t in range(int(most.max(initial=0))):
            rows = rows[most[rows] > t]
            rows = rows[self.words[a[rows] + t] == self.words[b[rows] + t]]
            if not len(rows):
                break
            found[rows] += 1
        return found

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from the different places a and b on."""
        shift = _SHIFT[a % MODULUS, b % MODULUS]
        found = self._agree(a, b, shift)
        rows = np.flatnonzero(found == shift)
        x, y = self.rank[self.index[a[rows] + shift[rows]]], self.rank[self.index[b[rows] + shift[rows]]]
        low, gap = np.minimum(x, y), np.abs(x - y)
        level = np.frexp(gap)[1] - 1
        for k in np.unique(level):
            mine = level == k
            part = self.table[k]
            found[rows[mine]] += np.minimum(part[low[mine]], part[low[mine] + gap[mine] - (1 << int(k))])
        return found


def _grid(n: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, i, period, step) of the grid's pairs for texts of n words, in pieces."""
    periods = np.where(n >= min_length, n // min_exponent, 0)
    text = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(min_length - period, (min_exponent - 1) * period)
    pairs = -(-(n[text] - period) // step)
    total = np.cumsum(pairs)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        m = pairs[at:to]
        row = np.repeat(np.arange(at, to), m)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        yield text[row], nth * step[row], period[row], step[row]
        at = to


def find_runs(codes: np.ndarray, n: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in order of text, start and period.

    ``codes`` are the words of all texts, as numbers from 0, and ``n`` the words of each text.
    """
    found = [np.zeros((0, 4), np.int64)]
    # a word that occurs nowhere else before each text and behind the last
    begin = np.cumsum(n + 1) - n
    words = np.empty(int(n.sum()) + len(n) + 1, np.int64)
    words[np.append(begin - 1, len(words) - 1)] = -1 - np.arange(len(n) + 1)
    words[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(codes))] = codes
    kept = []
    for text, i, period, step in _grid(n, min_length, min_exponent):
        a = begin[text] + i
        row = np.flatnonzero(words[a] == words[a + period])
        # the words that agree on both sides are at least a step: half of it lies on one side
        forward, backward = row, row
        half = (min_length - min_length // min_exponent + 1) // 2
        for t in range(1, half):
            forward = forward[words[a[forward] + t] == words[a[forward] + period[forward] + t]]
            backward = backward[words[a[backward] - t] == words[a[backward] + period[backward] - t]]
        row = np.union1d(forward, backward)
        kept.append(np.column_stack([text[row], i[row], period[row]]))
    pairs = np.concatenate(kept) if kept else np.zeros((0, 3), np.int64)
    if not len(pairs):
        return found[0]
    # the texts that have such pairs, by themselves
    some = np.unique(pairs[:, 0])
    inside = np.concatenate([np.arange(begin[t] - 1, begin[t] + n[t]) for t in some] + [[len(words) - 1]])
    own = np.cumsum(n[some] + 1) - n[some]
    words = words[inside]
    text, a, period = np.searchsorted(some, pairs[:, 0]), None, pairs[:, 2]
    a = own[text] + pairs[:, 1]
    forward = SampledSuffixes(words).common(a, a + period)
    backward = SampledSuffixes(words[::-1]).common(len(words) - a, len(words) - a - period)
    length = forward + backward + period
    keep = length >= np.maximum(min_length, min_exponent * period)
    rows = np.column_stack([pairs[:, 0], a - backward - own[text], length, period])[keep]
    # a stretch comes with all multiples of its smallest period that fit
    rows = rows[np.lexsort(rows.T[::-1])]
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))] if len(rows) else rows
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def split_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, words of each text): what ASCII white space separates."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    flat = np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8)
    inside = ~_BLANK[flat]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)) if len(flat) else np.zeros(0, np.int64)
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])])
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    return words, np.diff(np.append(np.searchsorted(starts, begins), len(starts)))


def groups(sizes: list[int], at_once: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``at_once`` bytes; a longer text is one by itself."""
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > at_once:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def periodic_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, bytes_at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of ``docs`` (doc_id, text; other columns are ignored).

    runs is an array of (start, length, period), in words, by start, then period.  collapsed is the text's words
    without those that some run holds after its first period, joined by one space.  A null, empty or blank text
    has no runs and an empty collapsed text.  Repeated rows and null ids are kept, each row for itself; an empty
    table gives an empty result.  A text's arrays lie in one task: about 150 bytes a word of the longest text.
    """
    if min_exponent < 2 or min_length < 2 * min_exponent:
        raise ValueError("a run has at least two periods and twice min_exponent words")
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def make(ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
        words, n = split_words(texts)
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        rows = find_runs(codes, n, min_length, min_exponent)
        first = np.cumsum(n) - n
        change = np.zeros(len(codes) + 1, np.int64)
        np.add.at(change, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
        np.add.at(change, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
        keep = np.cumsum(change)[:-1] == 0
        upto = np.append(0, np.cumsum(keep))[np.append(first, len(codes))].astype(np.int32)
        words = words if keep.all() else words.filter(pa.array(keep))
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), words), b" ")
        bounds = np.searchsorted(rows[:, 0], np.arange(len(n) + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(c) for c in rows[:, 1:].T], ["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(bounds), runs).cast(run_type)
        return pa.RecordBatch.from_arrays([ids, runs, collapsed], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in groups(sizes, bytes_at_once):
                yield make(batch.column("doc_id").slice(a, b - a), texts.slice(a, b - a).to_pylist())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(giving_back(run), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
