"""LDA topics over bag-of-words vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.params import Params

BLOCK = 32_768  # counts of the rows updated together inside a task: a few MB, which a core's cache holds
INNER_ROUNDS = 100  # most updates of a row's topic shares per pass
INNER_CHANGE = 1e-3  # mean change at which a row is done
KEPT_SHARE = 0.8  # done rows are taken out of a block once fewer are open


def count_vectors(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """``row_ix, counts``: a sparse count vector per row; a row-wise step."""
    if not terms:
        raise ValueError("no term is frequent enough; lower min_df")
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="counts").transform(tokens)
    return counted.select("row_ix", "counts")


def digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function of positive numbers: moved beyond 6, then its asymptotic series."""
    x = np.array(x, dtype=np.float64)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out -= low / x
        x += low
    f = 1 / (x * x)
    series = f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132)))))
    return out + np.log(x) - 0.5 / x - series


def expected_log(dirichlet: np.ndarray) -> np.ndarray:
    """E[log p] for rows of Dirichlet parameters."""
    return digamma(dirichlet) - digamma(dirichlet.sum(axis=1))[:, None]


@dataclass
class LdaModel:
    """Topic-term parameters (topic, term) and the symmetric prior of a row's topics."""

    topics: np.ndarray
    alpha: float


def start_topics(seed: int, k: int, terms: int) -> np.ndarray:
    """Starting parameters near 1, from a hash of (seed, topic, term): the same wherever rows lie."""
    normal = NormalDist(1.0, 0.1)
    out = np.empty((k, terms))
    for topic in range(k):
        for term in range(terms):
            digest = hashlib.blake2b(f"{seed}|{topic}|{term}".encode(), digest_size=8).digest()
            out[topic, term] = normal.inv_cdf((int.from_bytes(digest, "big") + 0.5) / 2**64)
    return np.maximum(out, 0.05)


def row_topics(bounds: np.ndarray, term: np.ndarray, n: np.ndarray, beta: np.ndarray, alpha: float) -> np.ndarray:
    """Variational topic parameters of rows given as runs of (term, n); ``beta`` = exp E[log topics].

    Every row starts from equal shares and is updated until it is done, whatever rows lie beside it.
    """
    rows, k = len(bounds) - 1, len(beta)
    size = np.diff(bounds)
    total = np.bincount(np.repeat(np.arange(rows), size), n, rows)
    gamma = np.repeat((alpha + total / k)[:, None], k, axis=1)
    active = np.flatnonzero(size)
    words, size = beta[:, term], size[active]
    open_ = np.ones(len(active), dtype=bool)
    for _ in range(INNER_ROUNDS):
        if not open_.any():
            break
        if open_.sum() < KEPT_SHARE * len(active):  # done rows stay in the arrays, unchanged, until they are many
            inside = np.repeat(open_, size)
            words, n, active, size = words[:, inside], n[inside], active[open_], size[open_]
            open_ = open_[open_]
        theta = np.exp(expected_log(gamma[active]))
        shared = np.repeat(theta.T, size, axis=1)
        shared *= words
        share = n / (shared.sum(axis=0) + 1e-100)
        np.multiply(words, share, out=shared)
        new = alpha + theta * np.add.reduceat(shared, np.cumsum(size) - size, axis=1).T
        change = np.abs(new - gamma[active]).mean(axis=1)
        gamma[active[open_]] = new[open_]
        open_ &= change >= INNER_CHANGE
    return gamma


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, bounds, terms, counts) of blocks of a sparse vector column, of BLOCK counts or one row."""
    indices, values = (column.field(part) for part in ("indices", "values"))
    bounds = indices.offsets.to_numpy().astype(np.int64)
    index, value = indices.flatten().to_numpy(), values.flatten().to_numpy()
    start = stop = 0
    while stop < len(column):
        start, last = stop, int(np.searchsorted(bounds, bounds[stop] + BLOCK, "right")) - 1
        stop = min(max(last, start + 1), start + BLOCK, len(column))
        inside = slice(bounds[start] - bounds[0], bounds[stop] - bounds[0])
        yield start, stop, bounds[start : stop + 1] - bounds[start], index[inside], value[inside]


def lda_fit(counts: DataFrame, params: Params, n_terms: int | None = None) -> LdaModel:
    """Batch variational Bayes (Hoffman et al. 2010) on ``row_ix, counts`` with symmetric 1/k priors.

    Every pass reads all rows; tasks return topics x terms partial sums, which are added by term.  Starting
    values and updates do not depend on where rows lie.  The vectors are read once a pass, so they should
    come from a written table.
    """
    k = params.lda_topics
    alpha = eta = 1.0 / k
    if n_terms is None:
        n_terms = counts.select("counts").first().counts.size
    topics = start_topics(params.seed, k, n_terms)
    for _ in range(params.lda_iterations):
        topics = eta + _pass(counts, topics, alpha)
    return LdaModel(topics, alpha)


def _pass(counts: DataFrame, topics: np.ndarray, alpha: float) -> np.ndarray:
    shared = counts.sparkSession.sparkContext.broadcast(np.exp(expected_log(topics)))  # topics x max_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = shared.value
        sums = np.zeros_like(beta)
        for batch in batches:
            for _, _, bounds, term, n in _runs(batch.column("counts")):
                theta = np.exp(expected_log(row_topics(bounds, term, n, beta, alpha)))
                spread = np.repeat(theta.T, np.diff(bounds), axis=1)
                share = n / ((spread * beta[:, term]).sum(axis=0) + 1e-100)
                for topic in range(len(beta)):
                    sums[topic] += np.bincount(term, spread[topic] * share, beta.shape[1])
        met = np.flatnonzero(sums.sum(axis=0))
        parts = pa.array((sums * beta).T[met].tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), parts], names=["term", "part"])

    parts = counts.select("counts").mapInArrow(run, "term long, part array<double>")
    k = len(topics)
    sums = parts.groupBy("term").agg(*[F.sum(F.get("part", F.lit(i))).alias(f"t{i}") for i in range(k)]).collect()
    out = np.zeros_like(topics)
    for row in sums:  # at most max_features rows
        out[:, row[0]] = row[1:]
    return out


def topk_terms_per_topic(weights: DataFrame, top_n: int) -> DataFrame:
    """``topic_id, term, weight`` -> the ``top_n`` heaviest terms of each topic with rank and the
    label made of the first three."""
    by_weight = Window.partitionBy("topic_id").orderBy(F.desc("weight"), F.asc("term"))
    top = weights.withColumn("rank", F.row_number().over(by_weight).cast("long")).filter(F.col("rank") <= top_n)
    return with_topic_label(top).select("topic_id", "topic_label", "rank", "term", "weight")


def with_topic_label(top: DataFrame) -> DataFrame:
    listed = F.collect_list(F.struct("rank", "term")).over(Window.partitionBy("topic_id"))
    return top.withColumn("topic_label", joined_terms(listed, 3, " | "))


def joined_terms(ranked: Column, n: int, separator: str) -> Column:
    """First ``n`` terms, by rank, of an array of ``(rank, term)``."""
    terms = F.transform(F.sort_array(ranked), lambda x: x["term"])
    return F.array_join(F.slice(terms, 1, n), separator)


def lda_topic_terms(spark: SparkSession, model: LdaModel, terms: list[str], top_n: int) -> DataFrame:
    """Top terms by unnormalised topic weight.  The topic matrix is k x max_features at most."""
    rows = [(topic, term, float(x)) for topic, weights in enumerate(model.topics) for term, x in zip(terms, weights, strict=True)]
    return topk_terms_per_topic(spark.createDataFrame(rows, "topic_id long, term string, weight double"), top_n)


def lda_weights(counts: DataFrame, model: LdaModel) -> DataFrame:
    """``row_ix, topic_weights``: share of every topic in every row, as an array by topic id.

    A row without feature terms has its prior, equal shares.
    """
    shared = counts.sparkSession.sparkContext.broadcast((np.exp(expected_log(model.topics)), model.alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, alpha = shared.value
        for batch in batches:
            for start, stop, bounds, term, n in _runs(batch.column("counts")):
                gamma = row_topics(bounds, term, n, beta, alpha)
                weights = pa.array((gamma / gamma.sum(axis=1, keepdims=True)).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("row_ix")[start:stop], weights], names=["row_ix", "topic_weights"])

    return counts.select("row_ix", "counts").mapInArrow(run, "row_ix long, topic_weights array<double>")


def dominant_topic(weights: DataFrame, topic_terms: DataFrame) -> DataFrame:
    """Add the id (first on a tie) and label of the heaviest topic."""
    best = F.array_position("topic_weights", F.array_max("topic_weights")) - 1
    labels = topic_terms.select(
        F.col("topic_id").alias("dominant_topic_id"), F.col("topic_label").alias("dominant_topic_label")
    ).distinct()
    return weights.withColumn("dominant_topic_id", best.cast("long")).join(labels, "dominant_topic_id", "left")


def widen_weights(df: DataFrame, k: int) -> DataFrame:
    """``topic_weights`` as columns ``topic_0 .. topic_{k-1}``, for export."""
    wide = {f"topic_{i}": F.get("topic_weights", F.lit(i)) for i in range(k)}
    return df.withColumns(wide).drop("topic_weights")
