"""Best-fit packing of tokenised documents by patterns fitted with non-negative least squares.

The plan is made from the histogram of piece lengths alone, which has one bin for each length up to the
capacity whatever the size of the corpus.  Patterns are sorted tuples of a few lengths that fill a
sequence; how often to use each is fitted to the histogram by non-negative least squares, rounded down
to what the histogram holds, and the residual pieces are placed best fit, longest first, by counts.  A
plan is a list of slots: pieces ranked lo..hi among those of one length go to consecutive sequences at
one offset.

Pieces get a rank among those of their length without a shuffle by length: each task numbers its own
pieces, and the counts of (task, length) are summed up to running totals.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.session import giving_back, materialise

#: Bytes that the pre-tokens kept by a worker and their ids may take.
KEPT_BYTES = 16 << 20
#: Bytes that an entry of the kept pre-tokens takes besides its contents.
ENTRY_BYTES = 160
#: Text encoded at once, in bytes; bounds a task's memory.
BYTES_AT_ONCE = 1 << 20
#: (share of the fitted counts, whether to top up) of the roundings tried, and the least count that is topped up.
ROUNDINGS = ((1.0, True), (1.0, False), (0.5, False), (0.25, False))
LEAST_FITTED = 0.05
#: The pre-tokeniser of the public byte-level BPE (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# classes of bytes, for texts of ASCII and Latin-1 letters: blank, letter, digit, other
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.array(
    [
        _BLANK if c in b" \t\n\v\f\r" else _LETTER if c >= 128 or chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _OTHER
        for c in range(256)
    ],
    np.uint8,
)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level BPE vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoding(path: str):
    """The byte-level BPE of a tokenizer file.  Its ids rank the merges, which is checked."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = byte_alphabet()
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ranks = {bytes(letters[c] for c in token): model["vocab"][token] for token in (*letters, *merges)}
    if list(ranks.values())[256:] != sorted(ranks.values())[256:]:
        raise ValueError("the ids of this tokenizer do not follow its merges")
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[bytes, int]:
    """The added tokens of a tokenizer file by their strings, longest first.  They must be plain strings."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens", [])
    if any(t[how] for t in added for how in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens of this tokenizer take more than their strings")
    return {t["content"].encode(): t["id"] for t in sorted(added, key=lambda t: -len(t["content"]))}


def pre_token_edges(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in UTF-8 bytes of ASCII and Latin-1 letters, with the length as last entry.

    ``ends`` are the ends of the texts, which pre-tokens do not cross.
    """
    kind = _CLASS[flat]
    n = len(flat)
    blank = kind == _BLANK
    starts = np.zeros(n + 1, bool)
    starts[0] = starts[n] = True
    starts[ends[ends < n]] = True
    edge = starts.copy()  # of texts
    starts[1:n] |= kind[1:] != kind[:-1]
    # the last blank of a run goes alone if something follows it in its text; a space joins what follows
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    starts[last] = True
    starts[last[flat[last] == 32] + 1] = False
    for tail in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
        quote = np.flatnonzero((flat == 39) & starts[:n])
        fits = quote + len(tail) < n
        for i, c in enumerate(tail):
            fits &= (flat[np.minimum(quote + 1 + i, n - 1)] == c) & ~edge[np.minimum(quote + 1 + i, n)]
        quote = quote[fits & starts[np.minimum(quote + 1, n)]]
        starts[quote + 1] = False
        starts[quote + 1 + len(tail)] = True
    return np.flatnonzero(starts)


class WordEncoder:
    """Token ids of whole texts, by way of the distinct pre-tokens of a group of texts.

    Byte-level BPE never merges over the edge of a pre-token, so a distinct one is encoded once, and the ids
    of the first ones, up to ``KEPT_BYTES``, are kept.  Texts with other characters than ASCII and Latin-1 letters
    are encoded whole, to the same ids.  Strings of the file's added tokens become those tokens, as in the library,
    unless ``added`` is False.
    """

    def __init__(self, path: str, added: bool = True):
        self.model = load_encoding(path)
        self.added = added_tokens(path) if added else {}
        self.any_added = re.compile(b"(" + b"|".join(map(re.escape, self.added)) + b")") if self.added else None
        self.kept: dict[bytes, bytes] = {}
        self.kept_bytes = 0

    def word(self, word: bytes) -> bytes:
        ids = np.array(self.model.encode_ordinary(word.decode()), np.uint32).tobytes()
        if self.kept_bytes < KEPT_BYTES:
            self.kept[word] = ids
            self.kept_bytes += len(word) + len(ids) + ENTRY_BYTES
        return ids

    def whole(self, text: bytes) -> np.ndarray:
        parts = self.any_added.split(text) if self.any_added else [text]
        ids = [[self.added[p]] if p in self.added else self.model.encode_ordinary(p.decode()) for p in parts]
        return np.fromiter(chain.from_iterable(ids), np.uint32)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(sizes)
        odd = (flat == 0xC2) | (flat > 0xC3)
        odd[:-1] |= (flat[:-1] == 0xC3) & ((flat[1:] == 0x97) | (flat[1:] == 0xB7))  # the signs among the letters
        strange = np.zeros(len(texts), bool)
        strange[np.searchsorted(ends, np.flatnonzero(odd), "right")] = True
        if self.any_added:
            strange |= np.fromiter((self.any_added.search(t) is not None for t in texts), bool, len(texts))
        edges = pre_token_edges(flat, ends) if len(flat) else np.zeros(1, np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(flat)])
        if strange.any():
            text_of = np.searchsorted(ends, edges[:-1], "right")
            words = pc.if_else(pa.array(strange[text_of]), pa.scalar(b"", pa.large_binary()), words)
        coded = words.dictionary_encode()
        ids = [self.kept.get(w) or self.word(w) for w in coded.dictionary.to_pylist()]
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), np.uint32)
        first = np.cumsum(n_ids) - n_ids
        codes = coded.indices.to_numpy()
        n = n_ids[codes]
        upto = np.cumsum(n)
        out = pool[np.arange(n.sum()) - np.repeat(upto - n, n) + np.repeat(first[codes], n)]
        upto = np.append(0, upto)[np.searchsorted(edges, np.append(0, ends))]
        found = [out[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]
        for i in np.flatnonzero(strange):
            found[i] = self.whole(texts[i])
        return found


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, bytes_at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) as token ids and ``end_id``, cut into pieces of at most ``capacity`` ids.

    Only documents of more ids are cut; the first piece takes what the full ones behind it leave.  Columns:
    doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), and task and nth, the
    piece's place among those of its length in the task that made it.  A null text is an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = WordEncoder(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // bytes_at_once
            for group in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(at)) + 1):
                rows = []
                for i, ids in zip(group, encode([texts[i] for i in group]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        rows.append((docs[i], k, a, b - a, zlib.crc32(ids[a:b].tobytes()), task, seen[b - a]))
                        seen[b - a] += 1
                columns = list(zip(*rows, strict=True)) or [()] * 7
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return rows.mapInArrow(giving_back(run), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def patterns(histogram: np.ndarray, capacity: int, popular: int = 48) -> np.ndarray:
    """Sorted tuples of at most four lengths (0: none) that fill a sequence, from lengths that occur.

    All pairs; all triples with one of the ``popular`` most frequent lengths or of the ``popular`` shortest;
    and quadruples of two such lengths and two others that occur.
    """
    occurs = histogram > 0
    lengths = np.flatnonzero(occurs)
    common = np.union1d(lengths[np.argsort(-histogram[lengths], kind="stable")[:popular]], lengths[:popular])
    found = [(capacity,)] if occurs[capacity] else []
    found += [(a, capacity - a) for a in lengths if a * 2 <= capacity and occurs[capacity - a]]
    for c in common:
        rest = capacity - c
        found += [tuple(sorted((a, rest - a, c))) for a in lengths[lengths * 2 <= rest] if occurs[rest - a]]
    few = common[: popular // 4]
    for i, c in enumerate(few):
        for d in few[i:]:
            rest = capacity - c - d
            some = lengths[lengths * 2 <= rest][:: max(1, popular // 8)] if rest > 1 else lengths[:0]
            found += [tuple(sorted((a, rest - a, c, d))) for a in some if occurs[rest - a]]
    out = np.zeros((len(set(found)), 4), np.int64)
    for row, pattern in zip(out, sorted(set(found)), strict=True):
        row[: len(pattern)] = pattern
    return out


def fit_counts(patterns_: np.ndarray, histogram: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used by the patterns closest to the histogram (least squares).

    Accelerated projected gradient.
    """
    bins, used = len(histogram), patterns_ > 0

    def lengths_used(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns_[used], np.repeat(x, used.sum(axis=1)), minlength=bins)

    norm = np.ones(len(patterns_))
    for _ in range(30):  # power iteration for the step size
        y = lengths_used(norm)
        norm = np.where(used, y[patterns_], 0).sum(axis=1)
        largest = np.linalg.norm(norm)
        norm /= largest
    x = momentum = np.zeros(len(patterns_))
    t = 1.0
    for _ in range(rounds):
        gap = histogram - lengths_used(momentum)
        new = np.maximum(0, momentum + np.where(used, gap[patterns_], 0).sum(axis=1) / largest)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        momentum, x = new + (old - 1) / t * (new - x), new
    return x


def plan(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Slots (length, lo, hi, first sequence, offset), sorted, and the number of sequences.

    ``histogram[l]`` counts pieces of l tokens.  Pieces with rank lo <= r < hi among those of their length go
    to sequence first + r - lo, at ``offset``.  Every piece has exactly one slot.  Roundings of the fitted
    counts are tried, and the one with the fewest sequences is kept: down, then topped up with patterns that the
    histogram still holds; and down from the whole, half and a quarter of them, which leaves more short pieces
    to fill the sequences of the best fit.
    """
    table = patterns(histogram, capacity) if histogram.any() else np.zeros((0, 4), np.int64)
    fitted = fit_counts(table, histogram.astype(float)) if len(table) else np.zeros(0)
    tried = [_rounded(table, fitted * share, histogram, capacity, top_up) for share, top_up in ROUNDINGS]
    bundles = min(tried, key=lambda bundles: sum(n for _, n in bundles))
    slots, used, first = [], np.zeros(capacity + 1, np.int64), 0
    for pattern, times in bundles:
        offset = 0
        for length in pattern:
            slots.append((length, used[length], used[length] + times, first, offset))
            used[length] += times
            offset += length
        first += times
    return np.array(sorted(slots), np.int64).reshape(-1, 5), first


def _rounded(table: np.ndarray, fitted: np.ndarray, histogram: np.ndarray, capacity: int, top_up: bool) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences): the fitted counts rounded down, topped up if asked for, then the residual by best fit."""
    left = histogram.astype(np.int64).copy()
    bundles = []
    used = np.argsort(-fitted, kind="stable")[: np.count_nonzero(fitted > LEAST_FITTED)]
    for up in range(1 + top_up):
        for i in used:
            pattern = tuple(int(x) for x in table[i] if x)
            most = min(left[length] // pattern.count(length) for length in pattern)
            times = int(min(most, np.floor(fitted[i]))) if not up else int(most)
            if times > 0:
                bundles.append((pattern, times))
                for length in pattern:
                    left[length] -= times
    return bundles + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of a histogram; equal sequences are handled together."""
    space: dict[int, list[list]] = defaultdict(list)  # room left -> [lengths, number of sequences] of open ones
    for length in range(capacity, 0, -1):
        while left[length]:
            room = min((r for r in space if r >= length), default=None)
            if room is None:
                each = min(capacity // length, int(left[length]))
                group = [(length,) * each, int(left[length]) // each]
                left[length] -= each * group[1]
            else:
                old = space[room].pop()
                n = min(int(left[length]), old[1])
                if n < old[1]:
                    space[room].append([old[0], old[1] - n])
                if not space[room]:
                    del space[room]
                group = [(*old[0], length), n]
                left[length] -= n
            space[capacity - sum(group[0])].append(group)
    return [(tuple(lengths), n) for groups in space.values() for lengths, n in groups]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    Sequences hold at most ``capacity`` tokens and have no gaps.  Repeated rows are packed each for itself; a
    null doc_id stays null; an empty table gives an empty result.
    """
    made = materialise(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    counts = made.groupBy("length", "task").count()
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.select("length", "task", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "piece_counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    slots, _ = plan(histogram, capacity)
    keys = slots[:, 0] * (1 << 44) + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            slot = slots[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1]
            sequence = pa.array(slot[:, 3] + rank - slot[:, 1])
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, sequence, pa.array(slot[:, 4])], names)

    ranked = made.join(counts.select("length", "task", "base"), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
