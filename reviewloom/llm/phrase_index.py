"""Benchmark decontamination with a distributed positional inverted index.

The index is a Parquet table of segments.  A segment holds a run of whole documents: their ids and word
counts, a dictionary of its words, and for every word the postings, i.e. its positions in order.
Postings never leave their segment, so nothing is shuffled by word and frequent words are no hot keys;
segments are spread over the cluster like any rows.

Phrases (windows of benchmark items) are written as a second table, in blocks of bounded size.  Each
task reads the blocks one after the other, and for each segment intersects the postings of a phrase's
words, shifted by their offsets in the phrase, starting from the word that is rarest in the segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shared import word_codes
from reviewloom.session import giving_back, materialise, scratch_path, shared_rows

#: A segment is closed at this many words; a longer document is a segment of its own.
SEGMENT_WORDS = 1 << 18
#: Phrases in one block of the phrase table.
BLOCK_PHRASES = 20_000
#: Start positions tested at once; bounds a task's memory.
STARTS_AT_ONCE = 1 << 21

_SEGMENT = "docs array<long>, n_words array<int>, words binary, sizes binary, counts binary, postings binary"
_BLOCK = "items array<long>, words binary, sizes binary, n_words binary, phrases binary, item_of binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, np.int32).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32)


def _dictionary(words: pa.Array) -> tuple[bytes, bytes]:
    words = words.cast(pa.large_binary())
    return b"".join(words.to_pylist()), _pack(pc.binary_length(words).to_numpy(zero_copy_only=False))


def _words(data: bytes, sizes: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(_unpack(sizes), dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _segment(docs: list, texts: list[bytes | None]) -> pa.RecordBatch:
    codes, words, n_words = word_codes(texts)
    order = np.argsort(codes.astype(np.int32), kind="stable")
    counts = np.bincount(codes, minlength=len(words))
    # one position is left free after each document, so that no phrase runs over its end
    positions = order + np.repeat(np.arange(len(docs)), n_words)[order]
    data, sizes = _dictionary(words)
    steps = np.diff(positions, prepend=0)
    row = [docs, n_words.astype(np.int32), data, sizes, _pack(counts), _pack(steps)]
    types = (pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4)
    arrays = [pa.array([x], t) for x, t in zip(row, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["docs", "n_words", "words", "sizes", "counts", "postings"])


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of ``docs`` (doc_id, text; other columns are ignored), written to the shared folder.

    Every row is indexed with its whole text; a null or empty text has no words.  Repeated and null ids
    are kept, each row as a document of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                size += 1 + len(text or b"") // 5  # about five letters to a word
                if size >= segment_words:
                    yield _segment(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _segment(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return materialise(rows.mapInArrow(giving_back(run), _SEGMENT), "positional_index")


def write_phrases(items: DataFrame, window: int | None = 10, block_phrases: int = BLOCK_PHRASES) -> str:
    """Phrases of ``items`` (item_id, text) as a table of blocks; returns its path.

    A phrase is each run of ``window`` words; the whole text where that is shorter (or window is None).
    Items with a null id, or without words, have no phrase.
    """

    def block(ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        codes, words, n_words = word_codes(texts)
        begin = np.cumsum(n_words) - n_words
        length = n_words if window is None else np.minimum(n_words, window)
        runs = np.where(n_words > 0, n_words - length + 1, 0)
        item_of = np.repeat(np.arange(len(ids)), runs)
        starts = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + begin[item_of]
        size = length[item_of]
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        data, sizes = _dictionary(words)
        row = [ids, data, sizes, _pack(size), _pack(codes[flat]), _pack(item_of)]
        types = (pa.list_(pa.int64()), *[pa.binary()] * 5)
        arrays = [pa.array([x], t) for x, t in zip(row, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["items", "words", "sizes", "n_words", "phrases", "item_of"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list = []
        size = 0
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(item)
                texts.append(text)
                size += 1 + len(text) // 5
                if size >= block_phrases:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield block(ids, texts)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).dropna()
    path = scratch_path(items.sparkSession, "phrases")
    rows.mapInArrow(run, _BLOCK).write.parquet(path)
    return path


class _Postings:
    """A segment as arrays: all (word, position) pairs in order, as one sorted array of keys."""

    def __init__(self, row: dict):
        self.docs, self.n_words = row["docs"], np.array(row["n_words"], np.int64)
        self.words = _words(row["words"], row["sizes"])
        self.counts = _unpack(row["counts"]).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.positions = np.cumsum(_unpack(row["postings"]).astype(np.int64))
        self.span = int(self.n_words.sum()) + len(self.docs) + 1
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.span + self.positions
        self.doc_ends = np.cumsum(self.n_words + 1)  # the free position of each document
        self.doc_starts = self.doc_ends - self.n_words - 1

    def held(self, word: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = word * self.span + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key


class _Phrases:
    """A block of phrases as a matrix of word numbers, -1 behind a phrase's end."""

    def __init__(self, row: dict):
        self.items = np.array(row["items"], np.int64)
        self.words = _words(row["words"], row["sizes"])
        self.n_words, flat = _unpack(row["n_words"]).astype(np.int64), _unpack(row["phrases"])
        self.item_of = _unpack(row["item_of"])
        width = int(self.n_words.max(initial=0))
        self.inside = np.arange(width) < self.n_words[:, None]
        self.matrix = np.full((len(self.n_words), width), -1, np.int64)
        self.matrix[self.inside] = flat

    def in_segment(self, seg: _Postings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, its words' numbers in the segment, their offsets, rarest word first), phrases with an absent word left out."""
        found = pc.fill_null(pc.index_in(self.words, value_set=seg.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        words = np.where(self.inside, np.append(found, -1)[self.matrix], -1)
        rows = np.flatnonzero((self.n_words > 0) & ~((words < 0) & self.inside).any(axis=1))
        words = words[rows]
        frequency = np.where(words >= 0, seg.counts[np.maximum(words, 0)], np.iinfo(np.int64).max)
        order = np.argsort(frequency, axis=1, kind="stable")
        return rows, np.take_along_axis(words, order, axis=1), order


def phrase_starts(seg: _Postings, phrases: _Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, start position) of all occurrences, in pieces."""
    if not len(seg.keys) or not len(phrases.n_words):
        return
    rows, words, order = phrases.in_segment(seg)
    if not len(rows):
        return
    count = seg.counts[words[:, 0]]
    total = np.cumsum(count)
    at = 0
    while at < len(rows):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + STARTS_AT_ONCE, "right")))
        n = count[at:to]
        which = np.repeat(np.arange(at, to), n)
        posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seg.first[words[at:to, 0]], n)
        start = seg.positions[posting] - order[which, 0]
        for j in range(1, words.shape[1]):
            word = words[which, j]
            ok = (word < 0) | seg.held(word, start + order[which, j])
            which, start = which[ok], start[ok]
        if len(which):
            yield rows[which], start
        at = to


def _over_segments(index: DataFrame, schema: str, make: Callable[[_Postings], pa.RecordBatch]) -> DataFrame:
    """``make`` gives the rows of the result for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                seg = _Postings(batch.slice(row, 1).to_pylist()[0])
                yield make(seg)

    return index.mapInArrow(giving_back(run, _BlockCache.clear), schema)


class _BlockCache:
    """The blocks of a phrase table, decoded once in a task if there is one, else read anew for each segment."""

    kept: dict[str, list[_Phrases]] = {}

    @classmethod
    def clear(cls) -> None:
        cls.kept.clear()

    @classmethod
    def blocks(cls, path: str) -> Iterator[_Phrases]:
        if path in cls.kept:
            yield from cls.kept[path]
            return
        first = None
        n = 0
        for row in shared_rows(path):
            n += 1
            block = _Phrases(row)
            first = block if n == 1 else None
            yield block
        if n <= 1:
            cls.kept.clear()
            cls.kept[path] = [first] if first else []


def phrase_matches(index: DataFrame, items: DataFrame, window: int | None = None) -> DataFrame:
    """(doc_id, item_id, word_from, n_words): every exact occurrence of an item's phrases.

    word_from counts words from 0 in the document.  With ``window`` None the phrase is the whole item.
    """
    path = write_phrases(items, window)

    def make(seg: _Postings) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for block in _BlockCache.blocks(path):
            for phrase, start in phrase_starts(seg, block):
                doc = np.searchsorted(seg.doc_ends, start, "right")
                out[0] += [seg.docs[d] for d in doc.tolist()]
                out[1] += block.items[block.item_of[phrase]].tolist()
                out[2] += (start - seg.doc_starts[doc]).tolist()
                out[3] += block.n_words[phrase].tolist()
        names = ["doc_id", "item_id", "word_from", "n_words"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    return _over_segments(index, "doc_id long, item_id long, word_from long, n_words long", make)


def proximity_matches(index: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(doc_id, item_id, word_from): occurrences of an item's rarest word (in the segment; the first such) with
    every other word of the item at most ``slop`` words away in the same document."""
    path = write_phrases(items, None)

    def make(seg: _Postings) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for block in _BlockCache.blocks(path):
            if not len(seg.keys) or not len(block.n_words):
                continue
            rows, words, _ = block.in_segment(seg)
            for phrase, terms in zip(rows.tolist(), words, strict=True):
                at = seg.positions[seg.first[terms[0]] : seg.first[terms[0]] + seg.counts[terms[0]]]
                doc = np.searchsorted(seg.doc_ends, at, "right")
                for word in np.unique(terms[1:][terms[1:] >= 0]):
                    low = np.maximum(at - slop, seg.doc_starts[doc])
                    high = np.minimum(at + slop, seg.doc_ends[doc] - 1)
                    near = np.searchsorted(seg.keys, word * seg.span + high, "right") > np.searchsorted(seg.keys, word * seg.span + low)
                    at, doc = at[near], doc[near]
                out[0] += [seg.docs[d] for d in doc.tolist()]
                out[1] += [int(block.items[block.item_of[phrase]])] * len(at)
                out[2] += (at - seg.doc_starts[doc]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "item_id", "word_from"])

    return _over_segments(index, "doc_id long, item_id long, word_from long", make)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for every row of ``docs`` (doc_id, text).

    n_hit counts the document's words inside any occurrence of a window of any item; ``items`` holds the
    distinct ids of the items with such windows.  A null or empty text has no words and no hit; an item with
    a null id, a null text or no words is no item; repeated item ids count once; repeated documents each
    get a row; empty tables give no rows or no hits.
    """
    index, path = build_index(docs), write_phrases(items, window)

    def make(seg: _Postings) -> pa.RecordBatch:
        cover = np.zeros(seg.span + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for block in _BlockCache.blocks(path):
            for phrase, start in phrase_starts(seg, block):
                np.add.at(cover, start, 1)
                np.add.at(cover, start + block.n_words[phrase], -1)
                doc = np.searchsorted(seg.doc_ends, start, "right")
                pairs.append(np.unique(np.column_stack([doc, block.items[block.item_of[phrase]]]), axis=0))
        hits = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
        found = np.unique(np.concatenate(pairs), axis=0)
        n_items = np.bincount(found[:, 0], minlength=len(seg.docs)) if len(seg.docs) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(n_items)]).astype(np.int32)
        arrays = [
            pa.array(seg.docs, pa.int64()),
            pa.array(seg.n_words),
            pa.array(hits[seg.doc_ends] - hits[seg.doc_starts]),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[:, 1])),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_hit", "items"])

    return _over_segments(index, "doc_id long, n_words long, n_hit long, items array<long>", make)
