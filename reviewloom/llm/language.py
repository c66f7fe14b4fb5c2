"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Letters are lower-cased, everything else is a space, runs of spaces count once, and each text is framed by
spaces.  n-grams are hashed to ``DIMS`` features; a feature's value is its share of the text's n-grams times
its inverse document frequency over all learning documents.  Weights are learned one document at a time
with follow-the-regularised-leader and an elastic-net penalty on a bounded sample, and a temperature
fitted on the rest of that sample calibrates the probabilities.  A text's logits are means over its
n-grams, so prediction is a gather and a sum over whole texts, with no list of distinct n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.session import giving_back

DIMS = 1 << 15
ORDERS = (2, 3)
#: Characters handled at once; a longer text is cut into framed pieces of this length, whose n-grams add up.
PIECE = 1 << 20
#: Feature values are multiplied by this, so that they are about one.
UNIT = 64.0
UNDETERMINED = "und"


@lru_cache(maxsize=2)
def _letters(limit: int) -> np.ndarray:
    """Code point -> lower-cased letter, or space."""
    out = np.full(limit, 32, np.uint32)
    for c in range(limit):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all n-grams, first n-gram and number of n-grams of each range), ranges in text order.

    There are len(ORDERS) ranges for each text, one order after the other.
    """
    flat = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = _letters(0x10000 if flat.max() < 0x10000 else 0x110000)[flat]
    blank = flat == 32
    kept = ~blank
    kept[0] = True
    kept[1:] |= ~blank[:-1]
    place = np.cumsum(kept) - 1
    a = flat[kept]
    frames = place[np.cumsum([0, *(len(t) + 1 for t in texts)])]
    lead, size = frames[:-1], np.diff(frames) + 1
    hashes, begins, counts, at = [], [], [], 0
    for n in ORDERS:
        h = np.full(max(0, len(a) - n + 1), 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ a[i : len(a) - n + 1 + i]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        hashes.append((h & np.uint32(DIMS - 1)).astype(np.int32))
        begins.append(lead + at)
        counts.append(np.maximum(0, size - n + 1))
        at += len(h)
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(counts)


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(owner, text) of groups of at most about PIECE characters."""
    owner: list[int] = []
    group: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            part = text[at : at + PIECE]
            owner.append(i)
            group.append(part)
            size += len(part)
            if size >= PIECE:
                yield owner, group
                owner, group, size = [], [], 0
    if owner:
        yield owner, group


def _sum_ranges(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values[begin:begin + count]; zero for empty ranges."""
    out = np.zeros(len(begins))
    some = counts > 0
    edges = np.column_stack([begins[some], begins[some] + counts[some]]).ravel()
    if len(edges):
        out[some] = np.add.reduceat(np.append(values, 0.0), edges)[::2]
    return out


@dataclass
class Model:
    """Languages, weights (language, feature) that include the idf, intercepts and the temperature."""

    languages: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logits by text, number of n-grams by text); the mean of the weights of a text's n-grams."""
        sums, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for owner, group in _pieces(texts):
            h, begins, counts = ngrams(group)
            owners = np.tile(owner, len(ORDERS))
            np.add.at(total, owners, counts)
            for k, row in enumerate(self.weights):
                np.add.at(sums[:, k], owners, _sum_ranges(row[h], begins, counts))
        return sums * (UNIT / np.maximum(total, 1))[:, None] + self.intercepts, total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        logits = self.logits(texts)[0] / self.temperature
        p = softmax(logits)
        best = p.argmax(axis=1)
        has_letter = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter, strict=True)]
        return names, np.where(has_letter, p[np.arange(len(best)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, proximal, per coordinate, with L1 and L2 penalties (McMahan et al. 2013)."""

    def __init__(self, classes: int, dims: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((classes, dims + 1)), np.zeros((classes, dims + 1))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = softmax((w @ x)[None])[0]
        g[y] -= 1
        g = g[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Number of rows of ``docs`` (text) with each feature, over all rows; the last entry is the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            df[DIMS] += len(texts)
            seen = np.zeros(DIMS, bool)
            last = None
            for owner, group in _pieces(texts):
                h, begins, counts = ngrams(group)
                for k, i in enumerate(owner):
                    if i != last:  # a long text's pieces follow one another
                        df[:DIMS] += seen
                        seen[:] = False
                    last = i
                    for b, c in zip(begins[k :: len(group)], counts[k :: len(group)], strict=True):
                        seen[h[b : b + c]] = True
            df[:DIMS] += seen
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["feature", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for feature, n in docs.select("text").mapInArrow(giving_back(run), "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        out[feature] = n  # at most DIMS + 1 rows
    return out


def _sample_features(docs: DataFrame) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """(doc_id, lang, features, shares) of a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [np.zeros(DIMS, np.int64) for _ in texts]
            for owner, group in _pieces(texts):
                h, begins, sizes = ngrams(group)
                for i, b, c in zip(np.tile(owner, len(ORDERS)), begins, sizes, strict=True):
                    counts[i] += np.bincount(h[b : b + c], minlength=DIMS)
            at = [np.flatnonzero(c) for c in counts]
            shares = [c[a] / max(1, c.sum()) for c, a in zip(counts, at, strict=True)]
            features = [pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *features], ["doc_id", "lang", "at", "x"])

    table = docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, at array<int>, x array<float>").toArrow()
    columns = [table.column(c).combine_chunks() for c in ("doc_id", "lang", "at", "x")]
    features = [(a.values.to_numpy(), x.values.to_numpy()) for a, x in zip(columns[2], columns[3], strict=True)]
    return sorted(zip(columns[0].to_pylist(), columns[1].to_pylist(), *zip(*features, strict=True), strict=True), key=lambda r: r[:2]) if features else []


def fit(docs: DataFrame, sample_rows: int = 4000, epochs: int = 3) -> Model:
    """A model of ``docs`` (doc_id, text, lang), all of which may be learned from.

    Document frequencies cover all rows with a text and a language.  Weights and temperature are fitted on at
    most ``sample_rows`` rows: an equal number of each language (20 at least), those with the smallest
    hashed ids (of rows that share an id and language, the first text).  A fifth of them,
    drawn with a fixed seed, is kept for the temperature.
    """
    known = docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    named = known.select("doc_id", "lang").distinct()
    sizes = dict(tuple(r) for r in named.groupBy("lang").count().collect())  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, DIMS)), np.zeros(0), 1.0)
    df = document_frequencies(known)
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
    chosen = smallest_hashes(named, "doc_id", "lang", sizes, max(20, sample_rows // len(languages)))
    picked = F.broadcast(chosen)  # at most sample_rows, or 20 a language
    texts = known.join(picked, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = _sample_features(texts)
    number = {name: i for i, name in enumerate(languages)}
    examples = [(np.append(at, DIMS), np.append(UNIT * x * idf[at], 1.0), number[lang]) for _, lang, at, x in rows]
    order = np.random.default_rng(7).permutation(len(examples))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    learner = Ftrl(len(languages), DIMS)
    for _ in range(epochs):
        for i in used:
            learner.learn(*examples[i])
    w = learner.weights()
    logits = np.array([w[:, examples[i][0]] @ examples[i][1] for i in held]).reshape(len(held), len(languages))
    right = np.array([examples[i][2] for i in held], int)
    return Model(languages, w[:, :DIMS] * idf, w[:, DIMS], temperature(logits, right))


def smallest_hashes(rows: DataFrame, key: str, kind: str, sizes: dict, each: int) -> DataFrame:
    """(key, kind) of ``rows``, which are distinct: of each kind the ``each`` rows with the smallest hash of ``key``.

    Only hashes below a cut, under which four times as many are expected, meet in a task; a kind whose
    hashes leave fewer than ``each`` there gives those.
    """
    span = 1 << 40
    hashed = F.pmod(F.xxhash64(key), F.lit(span))
    cuts = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int(span * min(1.0, 4 * each / n)))])
    near = rows.withColumn("h", hashed).filter(F.col("h") < F.element_at(cuts, F.col(kind)))
    place = Window.partitionBy(kind).orderBy("h", key)
    return near.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= each).select(key, kind)


def temperature(logits: np.ndarray, right: np.ndarray) -> float:
    """The temperature with the least cross entropy, by golden section on its logarithm.

    The targets are smoothed by one row in n + 2, as in Platt's scaling, so that a sample without an error does
    not make the model certain.
    """
    if not len(right) or logits.shape[1] < 2:
        return 1.0
    smooth = 1 / (len(right) + 2)
    target = np.full(logits.shape, smooth / (logits.shape[1] - 1))
    target[np.arange(len(right)), right] = 1 - smooth

    def loss(t: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()

    low, high, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id as text leaves 2 when divided by 4 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(doc_id, lang_pred, score, *keep) for every row of ``docs`` (doc_id, text); only the text decides.

    A null text, one without a letter, or a model without languages gives ``und`` and score 0; ties between
    languages go to the first by name.  Repeated rows and null ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages times DIMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            columns = [*(batch.column(c) for c in ("doc_id", *keep)), pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *dict.fromkeys((*keep, "text")))
    schema = T.StructType([rows.schema[c] for c in ("doc_id", *keep)]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return rows.mapInArrow(giving_back(run), schema)
