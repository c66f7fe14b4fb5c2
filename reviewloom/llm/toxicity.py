"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector is shared by all ordered thresholds.  x marks
the presence of hashed words and of the five-byte runs of words framed as <word>.  The model is fitted on a
bounded sample of graded documents by proximal gradient with an L1 penalty, so that few features keep a
weight, and every document's expected grade is the sum of its probabilities of exceeding each threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.language import smallest_hashes
from reviewloom.llm.shared import word_codes

DIMS = 1 << 20
#: Text handled at once, in bytes; bounds a task's memory.
BYTES_AT_ONCE = 1 << 22
WORDS_AT_ONCE = 1 << 18
#: Share of the penalty in the second fit.
RELAXED = 0.2
#: Length of the byte runs.
GRAM = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def dictionary_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of all features of the words of a dictionary, in order of words."""
    framed = [b"<%b>" % w for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    flat = np.frombuffer(b"".join(framed), np.uint8)
    n = np.maximum(sizes - GRAM + 1, 0)
    word = np.repeat(np.arange(len(words)), n)
    at = np.arange(n.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n)
    h = np.full(len(at), GRAM, np.uint32)
    for i in range(GRAM):
        h = (h ^ flat[at + i]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    whole = np.fromiter(map(zlib.crc32, framed), np.int64, len(framed))
    word = np.concatenate([np.arange(len(words)), word])
    feature = np.concatenate([whole, h.astype(np.int64)]) & (DIMS - 1)
    order = np.argsort(word, kind="stable")
    return word[order], feature[order]


def text_features(texts: list[bytes | None], wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each group of texts: their number, and the distinct text * DIMS + feature in order; of the features
    marked in ``wanted``, if given."""
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    groups = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(sizes) // BYTES_AT_ONCE)) + 1)
    for group in groups:
        codes, words, n_words = word_codes([texts[i] for i in group])
        word, feature = dictionary_features(words.to_pylist())
        if wanted is not None:
            word, feature = word[wanted[feature]], feature[wanted[feature]]
        count = np.bincount(word, minlength=len(words))
        first = np.cumsum(count) - count
        text = np.repeat(np.arange(len(group)), n_words)
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(codes), WORDS_AT_ONCE):  # bounds memory
            some = np.flatnonzero(count[codes[at : at + WORDS_AT_ONCE]]) + at
            n = count[codes[some]]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[codes[some]], n)
            found.append(np.unique(np.repeat(text[some], n) * DIMS + feature[place]))
        yield len(group), np.unique(np.concatenate(found))


@dataclass
class Model:
    """Features with a weight, in order, their weights, the rising thresholds, and the P(grade > 0) from which
    a document counts as toxic."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    toxic_at: float = 0.5

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        out = [np.zeros(0)]
        dense = np.zeros(DIMS)
        dense[self.features] = self.weights
        for n, pairs in text_features(texts, dense != 0):
            out.append(np.bincount(pairs // DIMS, dense[pairs % DIMS], minlength=n))
        return np.concatenate(out)

    def above(self, texts: list[bytes | None]) -> np.ndarray:
        """P(grade > k) by text and threshold."""
        return sigmoid(self.scores(texts)[:, None] - self.thresholds)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, l1: float = 7.0, rounds: int = 400) -> Model:
    """The cumulative-link model of documents given as arrays of features; ``weight`` counts for the prior.

    A feature's penalty is ``l1`` standard deviations that its gradient has under the prior alone if it has
    nothing to do with grades, so that such features keep no weight whatever the size of the sample.  Those whose gradient under the prior is
    below their penalty are left out from the start; those that keep a weight are fitted again under a
    ``RELAXED`` share of their penalty, which takes back most of its shrinkage.
    """
    features, column = np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)))
    weight = weight / weight.sum()
    levels = int(grades.max()) + 1
    share = np.cumsum(np.bincount(grades, weight, levels))[:-1]
    cuts = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
    ends = np.concatenate([[-np.inf], cuts, [np.inf]])
    alone = weight * (1 - sigmoid(ends[grades + 1]) - sigmoid(ends[grades]))
    penalty = l1 * np.sqrt(np.bincount(column, minlength=len(features)) * (alone**2).mean())
    kept = np.flatnonzero(np.abs(np.bincount(column, alone[doc], minlength=len(features))) > penalty)
    place = np.full(len(features), -1)
    place[kept] = np.arange(len(kept))
    inside = place[column] >= 0
    features, penalty, doc, column = features[kept], penalty[kept], doc[inside], place[column[inside]]
    w = np.zeros(len(features))
    for share in (1.0, RELAXED):  # the second time over the features that kept a weight
        inside = w[column] != 0 if share < 1 else np.ones(len(column), bool)
        w, cuts = _descend(doc[inside], column[inside], grades, weight, cuts, w, share * penalty, rounds)
    kept = np.flatnonzero(w)
    p = sigmoid(np.bincount(doc, w[column], minlength=len(rows)) - cuts[0])
    return Model(features[kept], w[kept], cuts, best_cut(p, grades > 0, weight))


def _descend(doc, column, grades, weight, cuts, w, penalty, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient steps, with a rate for each coordinate."""
    levels = len(cuts) + 1
    speed_w, speed_c = np.full(len(w), 1e-8), np.full(len(cuts), 1e-8)
    for _ in range(rounds):
        s = np.bincount(doc, w[column], minlength=len(grades))
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = sigmoid(ends[grades + 1] - s), sigmoid(ends[grades] - s)
        p = np.maximum(high - low, 1e-12)
        g = np.bincount(column, (weight * (1 - high - low))[doc], minlength=len(w))
        g_cut = np.bincount(grades + 1, -weight * high * (1 - high) / p, levels + 1) + np.bincount(grades, weight * low * (1 - low) / p, levels + 1)
        g_cut = g_cut[1:-1]
        speed_w += g * g
        speed_c += g_cut * g_cut
        rate = 0.3 / np.sqrt(speed_w)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        cuts = np.maximum.accumulate(cuts - 0.1 / np.sqrt(speed_c) * g_cut)
    return w, cuts


def best_cut(p: np.ndarray, positive: np.ndarray, weight: np.ndarray, precision: float = 0.8) -> float:
    """The probability from which calling documents positive has the highest F1 on the sample, at a precision of
    at least ``precision``: midway between the last one taken and the next.  0.5 if nothing is so precise."""
    order = np.argsort(-p, kind="stable")
    hit, taken = np.cumsum((weight * positive)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (taken + (weight * positive).sum())
    f1[hit < precision * taken] = -1
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # equal probabilities go together
    last = int(np.argmax(f1))
    if f1[last] <= 0:
        return 0.5
    return float((p[order[last]] + (p[order[last + 1]] if last + 1 < len(p) else 0)) / 2)


def sample_graded(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(distinct features, toxic, how many labelled rows it stands for) of labelled documents: at most
    ``sample_rows`` // 2 of each label, those with the smallest hashed ids; of documents that share an id, the
    first text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("text").to_pylist(), []
            for n, pairs in text_features(texts):
                found += np.split(pairs % DIMS, np.searchsorted(pairs, np.arange(1, n) * DIMS))
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "at"])

    known = labels.filter("doc_id is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    total = dict(tuple(r) for r in known.groupBy("toxic").count().collect())  # a row for each label
    picked = smallest_hashes(known, "doc_id", "toxic", total, sample_rows // 2)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id")  # at most sample_rows // 2 a label
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, at array<int>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    at = found.column("at").combine_chunks()
    features = [at[int(i)].values.to_numpy().astype(np.int64) for i in order]
    toxic = found.column("toxic").to_numpy()[order].astype(np.int64)
    number = {label: n / max(1, (toxic == label).sum()) for label, n in total.items()}
    return features, toxic, np.array([number[t] for t in toxic.tolist()])


def severity_grades(rows: list[np.ndarray], toxic: np.ndarray, cuts: tuple[int, ...] = (6, 16), odds: float = 4.0) -> np.ndarray:
    """Ordered grades for documents labelled toxic or not: 0 if not; else 1, and one more for each of ``cuts``
    that the number of its markers reaches.

    Markers are features of at least ten toxic documents whose smoothed odds of standing in a toxic document
    are ``exp(odds)`` times those of standing in another.
    """
    features, column = np.unique(np.concatenate([*rows, np.zeros(0, np.int64)]), return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), np.fromiter(map(len, rows), np.int64, len(rows)))
    bad = np.bincount(column, toxic[doc], minlength=len(features))
    good = np.bincount(column, 1 - toxic[doc], minlength=len(features))
    n_bad, n_good = toxic.sum(), (1 - toxic).sum()
    log_odds = np.log((bad + 0.5) / (n_bad - bad + 0.5)) - np.log((good + 0.5) / (n_good - good + 0.5))
    marker = (bad >= 10) & (log_odds >= odds)
    n = np.bincount(doc, marker[column], minlength=len(rows))
    return np.where(toxic > 0, 1 + (n[:, None] >= np.array(cuts)).sum(axis=1), 0)


def grade(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, severity, grade, toxic) for every row of ``docs`` (doc_id, text; other columns are ignored).

    severity is the expected grade, grade the number of thresholds more likely exceeded than not, and toxic
    says that P(grade > 0) is at least the model's ``toxic_at``.  Null and empty texts have no features and get the
    prior.  Without a model (no labels of both kinds) severity is null and nothing is toxic.  Repeated rows
    and null ids are kept.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if model is None:
        none = F.lit(None).cast("double").alias("severity"), F.lit(0).alias("grade"), F.lit(False).alias("toxic")
        return texts.select("doc_id", *none)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most DIMS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = shared.value.above(batch.column("text").to_pylist())
            columns = [above.sum(axis=1), (above >= 0.5).sum(axis=1).astype(np.int32), above[:, 0] >= shared.value.toxic_at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "severity", "grade", "toxic"])

    return texts.mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> Model | None:
    """The model of documents labelled ``toxic`` 0 or 1, by ``severity_grades``; None without both labels."""
    rows, toxic, weight = sample_graded(docs, labels, sample_rows)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    return fit_ordinal(rows, severity_grades(rows, toxic), weight)
