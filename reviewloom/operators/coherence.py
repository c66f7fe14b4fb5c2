"""Topic coherence c_v (Röder, Both & Hinneburg 2015) from one pass over the tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.session import materialise

EPSILON = 1e-12
BLOCK = 1 << 16  # occurrences that meet their sets together


def topic_word_lists(topic_terms: DataFrame) -> DataFrame:
    """``topic_id, terms``: the terms of every topic in rank order."""
    listed = topic_terms.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("r"))
    return listed.select("topic_id", F.transform("r", lambda x: x["term"]).alias("terms"))


def word_sets(topic_terms: DataFrame) -> DataFrame:
    """``term, a, b``: the sets each topic word belongs to.  A single word is (w, w); two words of
    one topic are (a, b) with a < b.  Tens of rows per topic."""
    words = topic_terms.select("topic_id", "term")
    other = words.withColumnRenamed("term", "b")
    pairs = words.withColumnRenamed("term", "a").join(other, "topic_id").filter(F.col("a") <= F.col("b"))
    return pairs.select(F.explode(F.array("a", "b")).alias("term"), "a", "b").distinct()


def window_counts(tokens: DataFrame, sets: DataFrame, window: int) -> DataFrame:
    """``a, b, n``: number of sliding windows that hold a word of the set."""
    sets = materialise(sets.withColumn("model", F.lit("")), "word_sets")  # written, so that its size is known
    counted = model_window_counts(tokens.withColumn("models", F.array(F.lit(""))), sets, window)
    return counted.drop("model")


def model_window_counts(tokens: DataFrame, sets: DataFrame, window: int) -> DataFrame:
    """``model, a, b, n`` for the sets of several models at once; ``models`` of a row are those it counts for.

    An occurrence at position p lies in the windows that start at ``lo..hi``, a run of numbers;
    successive occurrences add only the starts that the one before has not covered.  So a window
    is never enumerated, and rows grow with occurrences, not with occurrences times window size.
    Occurrences meet their sets inside tasks, which return one sum per set.
    """
    # the topic words and their sets: top_words per topic
    listed = sorted({tuple(r) for r in sets.select("model", "a", "b", "term").collect()})
    words, models = sorted({term for *_, term in listed}), sorted({model for model, *_ in listed})
    marked = F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    found = F.filter(marked, lambda x: x["term"].isin(words))
    counts_for = F.array(*[F.array_contains("models", model) for model in models])
    # only topic words are shuffled, still packed by row, and exploded after that; rows that share a row_ix lie together
    placed = tokens.select("row_ix", counts_for.alias("counts_for"), F.size("tokens").alias("len"), found.alias("found")).filter(F.size("found") > 0)
    placed = placed.repartition("row_ix").sortWithinPartitions("row_ix").select("row_ix", "counts_for", "len", F.inline("found"))
    one_bit = [F.when(F.get("counts_for", F.lit(i)), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(models))]
    mask = reduce(lambda x, y: x + y, one_bit, F.lit(0))
    occurrences = placed.select("row_ix", mask.cast("long").alias("mask"), "len", "pos", "term")
    sums = occurrences.mapInArrow(_new_starts(listed, words, models, window), "model string, a string, b string, fresh long")
    return sums.groupBy("a", "b", "model").agg(F.sum("fresh").alias("n"))


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, cut where ``row_ix`` changes; equal ones must lie together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("row_ix")
        changes = np.flatnonzero(_changes(ids))
        if held and held[-1].column("row_ix")[-1] != ids[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            last = int(changes[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _changes(ids: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    codes = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def _new_starts(listed: list[tuple], words: list[str], models: list[str], window: int) -> Callable:
    """For ``mapInArrow``: the window starts that occurrences newly cover, added up by set."""
    sets = sorted({row[:3] for row in listed})
    number, code = {key: i for i, key in enumerate(sets)}, {word: i for i, word in enumerate(words)}
    of_word: list[list[int]] = [[] for _ in words]
    for model, a, b, term in listed:
        of_word[code[term]].append(number[model, a, b])
    size = np.array([len(x) for x in of_word], np.int64)
    first, flat = np.cumsum(size) - size, np.array([i for x in of_word for i in x], np.int32)
    bit = np.array([models.index(model) for model, _, _ in sets], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, known = np.zeros(len(sets), np.int64), pa.array(words, pa.string())
        for table in _whole_rows(batches):
            ids = table.column("row_ix").combine_chunks()
            row = np.append(0, np.cumsum(_changes(ids)))
            mask, length, pos = (table.column(c).to_numpy() for c in ("mask", "len", "pos"))
            term = pc.index_in(table.column("term"), known).to_numpy()
            for start in _parts(row):
                sums += fresh(row[start], mask[start], length[start].astype(np.int64), pos[start].astype(np.int64), term[start])
        met = np.flatnonzero(sums)
        columns = [pa.array([sets[i][c] for i in met], pa.string()) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[met], pa.int64())], names=["model", "a", "b", "fresh"])

    def fresh(row: np.ndarray, mask: np.ndarray, length: np.ndarray, pos: np.ndarray, term: np.ndarray) -> np.ndarray:
        in_order = np.lexsort((pos, row))
        n = size[term[in_order]]
        at = np.repeat(in_order, n)  # the occurrence, once for each of its sets
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        group = flat[first[term[at]] + nth]
        counted = (mask[at] >> bit[group]) & 1 == 1
        at, group = at[counted], group[counted]
        by_set = np.argsort(group, kind="stable")
        at, group = at[by_set], group[by_set]
        lo = np.maximum(0, pos[at] - (window - 1))
        hi = np.minimum(pos[at], np.maximum(0, length[at] - window))
        before = np.full(len(at), -1, np.int64)
        same = (group[1:] == group[:-1]) & (row[at][1:] == row[at][:-1])
        before[1:][same] = hi[:-1][same]
        new = hi - np.maximum(lo, before + 1) + 1
        out = np.zeros(len(sets), np.int64)
        np.add.at(out, group, new)
        return out

    return run


def _parts(row: np.ndarray) -> Iterator[slice]:
    """Slices of some thousand occurrences that end where a row ends."""
    start = 0
    while start < len(row):
        stop = int(np.searchsorted(row, row[min(start + BLOCK, len(row)) - 1], "right"))
        yield slice(start, stop)
        start = stop


def window_total(tokens: DataFrame, window: int) -> DataFrame:
    """One row: the number of windows; a text shorter than the window is one, an empty text none."""
    n = F.size("tokens")
    return tokens.agg(F.sum(F.when(n > 0, F.greatest(F.lit(1), n - window + 1))).alias("n"))


def coherence_cv(
    tokens: DataFrame, topic_terms: DataFrame, model_name: str, window: int = 110, eps: float = EPSILON
) -> DataFrame:
    """``model, topic_id, topic_label, coherence_cv`` per topic, and an ``overall`` mean row.

    Windows holding both words = holding a + holding b - holding either.  Each word's context
    vector is its NPMI with all words of its topic; its score is the cosine with the sum of them.
    """
    total = window_total(tokens, window).scalar()
    return coherence_scores(window_counts(tokens, word_sets(topic_terms), window), total, topic_terms, model_name, eps)


def coherence_scores(counts: DataFrame, total: int, topic_terms: DataFrame, model_name: str, eps: float = EPSILON) -> DataFrame:
    """The rows of ``coherence_cv`` from ``window_counts`` and the number of windows."""
    single = counts.filter(F.col("a") == F.col("b")).select(F.col("a").alias("word"), F.col("n").alias("n_word"))
    words = topic_terms.select("topic_id", "topic_label", "term")
    grid = words.select("topic_id", "topic_label", F.col("term").alias("w")).join(
        words.select("topic_id", F.col("term").alias("u")), "topic_id"
    )
    grid = grid.withColumns({"a": F.least("w", "u"), "b": F.greatest("w", "u")}).join(counts, ["a", "b"], "left")
    for side in ("w", "u"):
        named = single.select(F.col("word").alias(side), F.col("n_word").alias(f"n_{side}"))
        grid = grid.join(named, side, "left")
    grid = grid.na.fill(0, ["n", "n_w", "n_u"])
    both = F.when(F.col("w") == F.col("u"), F.col("n_w")).otherwise(F.col("n_w") + F.col("n_u") - F.col("n"))
    p_w, p_u, p_wu = F.col("n_w") / total, F.col("n_u") / total, both / total
    npmi = (
        F.when((p_w == 0) | (p_u == 0), F.lit(0.0))
        .when(p_wu == 1, F.lit(1.0))
        # also where a share is so near 1 that adding eps makes it 1
        .otherwise(F.coalesce(F.try_divide(F.log((p_wu + eps) / (p_w * p_u)), -F.log(p_wu + eps)), F.lit(1.0)))
    )
    context = grid.select("topic_id", "topic_label", "w", "u", npmi.alias("x"))
    summed = F.sum("x").over(Window.partitionBy("topic_id", "u"))
    cosine = F.try_divide(
        F.sum(F.col("x") * F.col("s")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("s") * F.col("s")))
    )
    per_word = context.withColumn("s", summed).groupBy("topic_id", "topic_label", "w").agg(
        F.coalesce(cosine, F.lit(0.0)).alias("score")
    )
    per_topic = per_word.groupBy(F.struct("topic_id", "topic_label").alias("topic")).agg(F.avg("score").alias("score"))
    # the rollup's grand total is the plain mean over topics
    rolled = per_topic.rollup("topic").agg(F.avg("score").alias("coherence_cv"))
    overall = F.lit("overall")
    return rolled.select(
        F.lit(model_name).alias("model"),
        F.coalesce(F.col("topic.topic_id").cast("string"), overall).alias("topic_id"),
        F.coalesce("topic.topic_label", overall).alias("topic_label"),
        "coherence_cv",
    )


def coherence_compare(
    lda_terms: DataFrame, clustered: DataFrame, cluster_terms: DataFrame, window: int = 110
) -> DataFrame:
    """Both models in one pass over ``row_ix, topic_id, tokens``: all reviews count for the LDA topics, those in a
    cluster for the clusters, with all topics scored."""
    names = {"LDA": lda_terms, "BERTopic": cluster_terms}
    inside = F.col("topic_id") != -1
    models = F.when(inside, F.array(*map(F.lit, names))).otherwise(F.array(F.lit("LDA")))
    sets = [word_sets(terms).withColumn("model", F.lit(name)) for name, terms in names.items()]
    sets = materialise(sets[0].unionByName(sets[1]), "word_sets")  # written, so that its size is known
    counts = model_window_counts(clustered.select("row_ix", "tokens", models.alias("models")), sets, window)
    counts = materialise(counts, "window_counts")
    n = F.size("tokens")
    windows = F.when(n > 0, F.greatest(F.lit(1), n - window + 1))
    totals = clustered.agg(F.sum(windows).alias("LDA"), F.sum(F.when(inside, windows)).alias("BERTopic")).first()
    scored = [
        coherence_scores(counts.filter(F.col("model") == name).drop("model"), totals[name], terms, name) for name, terms in names.items()
    ]
    return scored[0].unionByName(scored[1])


def coherence_plot_rows(coherence: DataFrame) -> DataFrame:
    return coherence.filter(F.col("topic_id") != "overall")
