"""Alignment of two tokenizers' tokens over a corpus, with a fast path for tokens of the same bytes.

Both tokenizers cut the same bytes.  Places where tokens of both end cut a text into groups; tokens whose bytes
overlap are linked; a pair of ids counts in how many documents it is linked.

An array gives for each id of A the id of B with the same bytes.  Pairs of that kind, nearly all of them one-to-one
groups, are counted in a vector as long as A's vocabulary, one a task.  Only the other pairs are shuffled, with the
number of documents of a chunk that hold them: a chunk is some thousand documents, so a frequent pair is a row a
chunk and no hot key.  The counts come back to the chunks, whose documents are held as arrays, and are summed
there by document.

Neither tokenizer merges over a place where a space follows another sign, so texts are cut there, and each
distinct cut of about a megabyte of texts is encoded and aligned once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.packing import byte_alphabet, load_encoding
from reviewloom.llm.periodic_runs import groups
from reviewloom.session import giving_back, materialise

#: Text encoded at once, in bytes, and text of a chunk; a longer text is one by itself.
BYTES_AT_ONCE, CHUNK_BYTES = 1 << 20, 1 << 23
#: Ids of B are below this.
B_IDS = 1 << 20

_CHUNK = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, pairs array<long>, pair_docs array<long>, entries binary, same_docs binary"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def cut_places(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where cuts of UTF-8 texts start, with the length as last entry: at each text, and at each space behind a
    sign that is surely no white space (white space beyond ASCII starts with bytes C2 and E1 to E3)."""
    before = np.concatenate([np.full(4, 32, np.uint8), flat])
    sign = (before > 0x20) & (before < 0x7F)
    tail = before >= 0x80
    for lead, low, high in ((1, 0xC3, 0xDF), (2, 0xE4, 0xEF), (3, 0xF0, 0xF7)):
        sign[lead:] |= tail[lead:] & (before[:-lead] >= low) & (before[:-lead] <= high)
    starts = np.zeros(len(flat) + 1, bool)
    starts[:-1] = (flat == 0x20) & sign[3:-1]
    starts[0] = True
    starts[ends] = True
    return np.flatnonzero(starts)


class Aligner:
    """Both tokenizers: A a byte-level BPE of ``tokenizers``, B a ``sentencepiece`` model that adds a space."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = load_encoding(a_path)
        with open(a_path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = byte_alphabet()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else b""
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or len(pieces) >= B_IDS:
            raise ValueError("pieces of this model go on behind a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        by_bytes = {x: i for i, x in enumerate(self.b_bytes) if self.b.is_byte(i)}
        by_bytes |= {x: i for i, x in enumerate(self.b_bytes) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        #: For each id of A the id of B with the same bytes, -1 without one.
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # "id," and "id|" for ids of A, "id," and "id;" for ids of B
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.signed = pa.array([f"{i}{sign}".encode() for i in range(most) for sign in ",|;"], pa.binary())

    def encoded(self, cuts: list[bytes]) -> tuple[list, list]:
        """Ids of A and of B for cuts, which start with a space; both empty where the tokens' bytes are not the cut's."""
        texts = [cut.decode("utf-8", "replace") for cut in cuts]
        a = [self.a.encode_ordinary(text) for text in texts]
        b = self.b.encode([text[1:] for text in texts], num_threads=1) if texts else []
        for i, (cut, text) in enumerate(zip(cuts, texts, strict=True)):
            if len(cut) == 1:
                b[i] = [self.space]
            if b"".join([self.b_bytes[x] for x in b[i]]) != cut or "\ufffd" in text and text.encode() != cut:
                a[i], b[i] = [], []
        return a, b

    def texts(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """([n_a, n_b, n_groups, n_links], digests, (text, link, occurrences)) of non-empty texts; a link is
        A's id * B_IDS + B's id."""
        flat = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        edges = cut_places(flat, text_ends)
        cuts = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(flat)])
        coded = cuts.dictionary_encode()
        codes, cuts = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        a_ids, b_ids = self.encoded(cuts)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((a_ids, n_a), (b_ids, n_b)))

        # the tokens of both cover the same bytes, cut after cut: places are those in all of them
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends, shared = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends, assume_unique=True)
        links = a[np.searchsorted(a_ends, ends)] * B_IDS + b[np.searchsorted(b_ends, ends)]
        cut_ends = np.append(0, a_ends)[np.cumsum(n_a)]
        n_groups, n_links = (np.diff(np.searchsorted(x, cut_ends, "right"), prepend=0) for x in (shared, ends))
        parts = self._groups(a, b, a_ends, b_ends, shared, np.cumsum(n_a + n_b))

        bounds = np.searchsorted(edges, np.append(0, text_ends))
        bad = np.maximum.reduceat((n_a == 0)[codes], bounds[:-1])
        counts = [np.where(bad, 0, np.add.reduceat(x[codes], bounds[:-1])) for x in (n_a, n_b, n_groups, n_links)]
        digests = []
        for x, y, wrong in zip(bounds[:-1].tolist(), bounds[1:].tolist(), bad.tolist(), strict=True):
            digests.append("" if wrong else hashlib.sha256(b"".join([parts[c] for c in codes[x:y].tolist()])[:-1]).hexdigest())
        known, local = np.unique(links, return_inverse=True)
        text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        mine = ~bad[text]
        codes, text = codes[mine], text[mine]
        n = n_links[codes]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(n_links) - n_links)[codes], n)
        keys, times = np.unique(np.repeat(text, n) * max(1, len(known)) + local[at], return_counts=True)
        return counts, digests, (keys // max(1, len(known)), known[keys % max(1, len(known))], times)

    def _groups(self, a, b, a_ends, b_ends, shared, upto) -> list[bytes]:
        """The groups of each cut as text, each group with its closing sign; ``upto`` counts the tokens of both."""
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        signed = np.empty(len(a) + len(b), np.int64)
        b_before = np.append(0, np.searchsorted(b_ends, shared, "right"))[a_group]
        signed[np.arange(len(a)) + b_before] = a * 3 + (a_ends == shared[a_group])
        signed[np.arange(len(b)) + np.searchsorted(a_ends, shared, "right")[b_group]] = b * 3 + 2 * (b_ends == shared[b_group])
        joined = self.signed.take(pa.array(signed))
        offsets = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1]
        data = joined.buffers()[2].to_pybytes() if len(joined) else b""
        bounds = offsets[np.append(0, upto)].tolist()
        return [data[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, np.int32).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32)


class _Chunk:
    """Documents of a chunk: one entry for each distinct pair of each document."""

    def __init__(self):
        self.ids, self.digests, self.counts = [], [], [[], [], [], []]
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, aligner: Aligner, ids: list, texts: list[bytes | None]) -> None:
        full = [i for i, t in enumerate(texts) if t]
        counts, digests = [np.zeros(len(ids), np.int64) for _ in range(4)], [""] * len(ids)
        if full:
            found, hashes, (text, link, times) = aligner.texts([texts[i] for i in full])
            for mine, new in zip(counts, found, strict=True):
                mine[full] = new
            for i, digest in zip(full, hashes, strict=True):
                digests[i] = digest
            self.entries.append((np.array(full)[text] + len(self.ids), link, times))
        for mine, new in zip(self.counts, counts, strict=True):
            mine.append(new)
        self.ids += ids
        self.digests += digests
        self.bytes += sum(len(t) for t in texts if t)

    def row(self, chunk: int, same: np.ndarray, same_docs: np.ndarray) -> pa.RecordBatch:
        """The chunk's row; pairs of the same bytes are counted into ``same_docs``."""
        doc, link, times = (np.concatenate(p) for p in zip(*self.entries, strict=True)) if self.entries else [np.zeros(0, np.int64)] * 3
        a, b = link // B_IDS, link % B_IDS
        alike = same[a] == b
        same_docs += np.bincount(a[alike], minlength=len(same))
        pairs, local, docs = np.unique(link[~alike], return_inverse=True, return_counts=True)
        # which is A's id for pairs of the same bytes, and else -1 and the place in ``pairs`` downwards
        which = np.empty(len(link), np.int64)
        which[alike], which[~alike] = a[alike], -1 - local
        entries = [_pack(np.diff(doc, prepend=0)), _pack(which), _pack(times)]
        sizes = np.array([len(e) for e in entries], "<i8").tobytes()
        counts = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in self.counts]
        return _chunk_row(chunk, self.ids, counts, self.digests, pairs, docs, sizes + b"".join(entries), None)


def _chunk_row(chunk, ids, counts, digests, pairs, docs, entries, same_docs) -> pa.RecordBatch:
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, *counts)]
    strings = pa.array([digests], pa.list_(pa.string()))
    arrays = [pa.array([chunk]), *lists, strings, pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int64()))]
    arrays += [pa.array([x], pa.binary()) for x in (entries, same_docs)]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _CHUNK.split(", ")])


def chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES, bytes_at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """``docs`` (doc_id, text) as rows of whole chunks, and a last row for each task with its vector of documents
    that hold an id of A linked with the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        same_docs = np.zeros(len(aligner.same), np.int64)
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in groups([len(t or b"") for t in texts], bytes_at_once):
                chunk.add(aligner, ids[a:b], texts[a:b])
                if chunk.bytes >= chunk_bytes:
                    yield chunk.row(number, aligner.same, same_docs)
                    number, chunk = number + 1, _Chunk()
        if chunk.ids:
            yield chunk.row(number, aligner.same, same_docs)
        if number & 0xFFFFFFFF or chunk.ids:
            yield _chunk_row(-1, [], [[]] * 4, [], [], [], None, same_docs.tobytes())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(giving_back(run), _CHUNK)


def _same_docs(made: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' vectors, of the vocabulary's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column("same_docs").to_pylist():
                total += np.frombuffer(data, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["a", "n"])

    counted = made.filter("same_docs is not null").select("same_docs").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for a, n in counted.collect():  # at most a row for each id of A
        out[a] = n
    return out


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Per document and per pair of ids, how tokenizers A (``tokenizers`` file) and B (``sentencepiece`` model) align.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``
    (doc_id, text; other columns are ignored).  A reads a space and the text, B the text.  n_best counts the links
    whose pair is the most frequent of their A id, ties included; count_sum adds up the pairs' document counts over
    links.  A text that is null, empty, or not the bytes that its tokens of A and of B stand for has no tokens: zeros
    and an empty digest.  Repeated rows and null ids are kept, each as a document of its own.

    Pairs: a, b, n_docs for every linked pair but those of the same bytes.  Empty tables give empty results.
    """
    spark = docs.sparkSession
    made = materialise(chunks(docs, a_path, b_path, chunk_bytes), "aligned_chunks")
    same_docs = _same_docs(made, len(Aligner(a_path, b_path).same))
    found = made.select("chunk", F.posexplode(F.arrays_zip("pairs", "pair_docs")).alias("at", "p"))
    found = found.select("chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.pair_docs").alias("docs"))
    counts = materialise(found.groupBy("pair").agg(F.sum("docs").alias("n_docs")), "pair_counts")
    best = same_docs.copy()
    highest = counts.groupBy(F.floor(F.col("pair") / B_IDS).alias("a")).agg(F.max("n_docs").alias("n"))
    for a, n in highest.collect():  # at most a row for each id of A
        best[a] = max(best[a], n)
    shared = spark.sparkContext.broadcast((same_docs, best))  # two vectors of A's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, top = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                yield _finished(batch.slice(row, 1), same, top)

    back = found.select("chunk", "at", "pair").join(counts, "pair").groupBy("chunk").agg(F.collect_list(F.struct("at", "n_docs")).alias("counted"))
    whole = made.filter("chunk >= 0").drop("pair_docs", "same_docs").join(back, "chunk", "left")
    pairs = counts.select(F.floor(F.col("pair") / B_IDS).alias("a"), F.pmod("pair", F.lit(B_IDS)).alias("b"), "n_docs")
    return whole.mapInArrow(giving_back(run), _RESULT), pairs


def _finished(row: pa.RecordBatch, same: np.ndarray, top: np.ndarray) -> pa.RecordBatch:
    """The documents of one chunk, with its pairs' counts."""

    def flat(name: str) -> pa.Array:
        return row.column(name).flatten()

    ids, pairs = flat("doc_id"), flat("pairs").to_numpy()
    counts = np.zeros(len(pairs), np.int64)
    counted = flat("counted")
    counts[counted.field("at").to_numpy()] = counted.field("n_docs").to_numpy()
    data = row.column("entries")[0].as_py()
    edges = 24 + np.append(0, np.cumsum(np.frombuffer(data[:24], "<i8")))
    doc, which, times = (_unpack(data[a:b]).astype(np.int64) for a, b in zip(edges[:-1], edges[1:], strict=True))
    doc = np.cumsum(doc)
    alike = which >= 0
    a, n = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
    a[alike], a[~alike] = which[alike], pairs[-1 - which[~alike]] // B_IDS
    n[alike], n[~alike] = same[which[alike]], counts[-1 - which[~alike]]
    n_best, count_sum = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    np.add.at(n_best, doc, np.where(n == top[a], times, 0))
    np.add.at(count_sum, doc, n * times)
    columns = [ids, *(flat(c) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), flat("groups_sha256")]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])
