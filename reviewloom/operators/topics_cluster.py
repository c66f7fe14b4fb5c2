"""Topics as density clusters of reduced TF-IDF vectors, described by class-based TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.frames import computed_once
from reviewloom.operators.cluster_tree import contracted, joined_levels, stable_clusters
from reviewloom.operators.graph import components, spanning_forest
from reviewloom.operators.sketched_svd import principal_axes, project
from reviewloom.operators.tokens import term_frequencies
from reviewloom.operators.topics_lda import joined_terms, topk_terms_per_topic
from reviewloom.operators.vector_blocks import GROUP_ROWS, Rows, build_index, in_reach, over_reach
from reviewloom.session import materialise

BLOCK = 1024  # rows handled at a time inside a task


# --- embedding -------------------------------------------------------------------------


def tfidf_vectors(counts: DataFrame, doc_freq: list[int]) -> DataFrame:
    """``row_ix, tfidf``: the weights of ``operators.tokens.tfidf`` as sparse vectors, row by row.

    ``counts`` holds count vectors, ``doc_freq`` the number of rows with each feature.
    """
    n = counts.count()
    idf = Vectors.dense([float(np.log((1 + n) / (1 + df)) + 1) for df in doc_freq])
    weighted = ElementwiseProduct(scalingVec=idf, inputCol="counts", outputCol="weighted").transform(counts)
    return Normalizer(p=2.0, inputCol="weighted", outputCol="tfidf").transform(weighted).select("row_ix", "tfidf")


def embed_svd(vectors: DataFrame, dim: int) -> tuple[DataFrame, np.ndarray]:
    """``row_ix, vec`` = U * S of the uncentred truncated SVD, and the singular values."""
    axes, singular = principal_axes(vectors, dim)
    return project(vectors, axes), singular


# --- clustering ------------------------------------------------------------------------


def _directions(vectors: DataFrame) -> DataFrame:
    """``row_ix, unit, h1, h2`` of ``row_ix, vec``: vectors scaled to length 1, and hashes that stand for them in narrow
    joins.  All are null for zero vectors and vectors with a null or non-finite component, which are near nothing."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    # each step reads the one before for every component
    rows = computed_once(vectors.select("row_ix", "vec"), ["vec"])
    rows = computed_once(rows.select("row_ix", "vec", length.alias("length")), ["vec", "length"])
    usable = (F.col("length") > 0) & (F.col("length") < float("inf"))
    rows = rows.select("row_ix", F.when(usable, F.transform("vec", lambda x: x / F.col("length"))).alias("unit"))
    rows = computed_once(rows, ["unit"])
    hashes = [F.when(F.col("unit").isNotNull(), F.xxhash64(F.lit(i), "unit")).alias(f"h{i}") for i in (1, 2)]
    return rows.select("row_ix", "unit", *hashes)


def _table_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def joined_rows(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and each column of a matrix of links is connected with: smallest ids go from rows
    to columns and back until none changes, so that dense links are never listed."""
    most = np.iinfo(np.int64).max
    while True:
        columns = np.minimum(columns, np.where(linked, rows[:, None], most).min(axis=0, initial=most))
        new = np.minimum(rows, np.where(linked, columns, most).min(axis=1, initial=most))
        if np.array_equal(new, rows):
            return rows, columns
        rows = new


def density_clusters(vectors: DataFrame, eps: float, min_pts: int, min_size: int) -> DataFrame:
    """``row_ix, cluster_id`` for ``row_ix, vec`` (array): density clusters, outliers -1.

    Density clustering after Ester et al. (1996) of vectors scaled to length 1, over all rows.  A row is core if
    at least ``min_pts`` rows, itself included, lie within ``eps``; cores within ``eps`` of each other share a
    cluster; every row joins the cluster of its nearest core within ``eps`` (the smallest row on a tie).
    Clusters under ``min_size`` become -1, the rest are numbered by size, then by smallest row.

    Copies of a vector count once, with their number.  Distinct vectors are held in an index of balls
    (``vector_blocks``), and two joins with the vectors in reach, as matrix products inside tasks, count neighbours,
    then link cores and assign rows.  Only core marks, spanning forests of links and assignments leave a task.
    Vectors out of reach are not shipped; where all vectors are far apart, as noise of many dimensions is, the
    work grows with the square of the distinct vectors.
    """
    min_cos = 1 - eps * eps / 2
    keyed = _directions(vectors)
    distinct = keyed.filter("unit is not null").groupBy("unit", "h1", "h2").agg(F.min("row_ix").alias("id"), F.count("*").alias("n"))
    distinct = materialise(distinct, "directions")
    found = vectors.select("row_ix", F.lit(-1).cast("long").alias("cluster_id"))
    n_points = distinct.count()
    if not n_points:
        return found
    index = build_index(distinct.select("id", "n", "unit"), n_points, BLOCK, eps, min(GROUP_ROWS, max(256, n_points // (4 * vectors.sparkSession.sparkContext.defaultParallelism))))

    def near(strip: Rows, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the strip and of ``unit``, some at a time, that can have one of the others within ``eps``."""
        for a in range(0, len(unit), BLOCK):
            close = in_reach(strip.unit, unit[a : a + BLOCK], np.array(eps))
            rows, columns = np.flatnonzero(close.any(axis=1)), a + np.flatnonzero(close.any(axis=0))
            if len(rows):
                yield rows, columns

    def count(counts: np.ndarray, at: int, strip: Rows, others: Rows) -> None:
        for rows, columns in near(strip, others.unit):
            counts[at + rows] += (strip.unit[rows] @ others.unit[columns].T >= min_cos) @ others.n[columns]

    def marked(counts: np.ndarray, own: Rows) -> pa.RecordBatch:
        core = counts >= min_pts
        parts = [core[a:b] for a, b in zip(own.bounds[:-1], own.bounds[1:], strict=True)]
        return _table_of(block=[b["block"] for b in own.blocks], core=[p.tobytes() for p in parts], cores=[int(p.sum()) for p in parts])

    cores = over_reach(index, eps, "block long, core binary, cores long", lambda own: np.zeros(len(own.ids), np.int64), count, marked)
    cores = materialise(cores, "core")

    def start(own: Rows) -> dict:
        core = own.per_row("core", "?")
        return {"core": core, "cosine": np.full(len(core), -2.0), "nearest": np.full(len(core), -1), "links": (np.zeros(0, np.int64),) * 2}

    def link(state: dict, at: int, strip: Rows, others: Rows) -> None:
        core = np.flatnonzero(others.per_row("core", "?"))
        for rows, columns in near(strip, others.unit[core]):
            some, here = core[columns], at + rows
            ids, cosine = others.ids[some], strip.unit[rows] @ others.unit[some].T
            top = cosine.max(axis=1)
            first = np.where(cosine == top[:, None], ids, np.iinfo(np.int64).max).min(axis=1)
            better = (top > state["cosine"][here]) | (top == state["cosine"][here]) & (first < state["nearest"][here])
            state["cosine"][here] = np.where(better, top, state["cosine"][here])
            state["nearest"][here] = np.where(better, first, state["nearest"][here])
            # the group of smaller number takes the links between two groups
            linked = (cosine >= min_cos) & state["core"][here, None] & (others.home[some] >= strip.home[0])
            a, b = joined_rows(linked, strip.ids[rows], ids)
            new, root = np.append(strip.ids[rows], ids), np.append(a, b)
            moved, old = new != root, state["links"]
            if moved.any():
                state["links"] = spanning_forest(np.append(new[moved], old[0]), np.append(root[moved], old[1]))

    def ended(state: dict, own: Rows) -> pa.RecordBatch:
        near = state["cosine"] >= min_cos
        a, b = state["links"]
        pairs = np.append(own.ids[near], a), np.append(state["nearest"][near], b)
        return _table_of(a=pairs[0], b=pairs[1], link=np.arange(len(pairs[0])) >= near.sum())

    found = over_reach(index, eps, "a long, b long, link boolean", start, link, ended, cores, lambda block: block["cores"] > 0)
    found = materialise(found, "links_and_nearest")
    roots = components(found.filter("link").select("a", "b"), "core_links")
    joined = found.filter("not link").select(F.col("a").alias("id"), F.col("b").alias("core")).join(roots, F.col("core") == F.col("node"), "left")
    joined = joined.select("id", F.coalesce("root", "core").alias("root")).join(distinct.select("id", "n", "h1", "h2"), "id")
    joined = materialise(joined, "assigned")
    sizes = joined.groupBy("root").agg(F.sum("n").alias("size"), F.min("id").alias("first")).filter(F.col("size") >= min_size)
    by_size = Window.orderBy(F.desc("size"), F.asc("first"))  # one row per cluster
    ids = sizes.select("root", (F.row_number().over(by_size) - 1).cast("long").alias("cluster_id"))
    named = materialise(joined.join(ids, "root").select("h1", "h2", "cluster_id"), "named")
    members = keyed.select("row_ix", "h1", "h2").join(named, ["h1", "h2"], "left")
    return members.select("row_ix", F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"))


def hierarchical_clusters(vectors: DataFrame, min_pts: int, min_size: int) -> DataFrame:
    """``row_ix, cluster_id`` for ``row_ix, vec`` (array): clusters of differing density, outliers -1.

    The most stable clusters of the density hierarchy (``cluster_tree``) of vectors scaled to length 1, over all rows;
    copies count with their number.  Parts that are joined at equal distances are joined at once.  Clusters are
    numbered by size, then by smallest row.  Zero vectors and vectors with a null or non-finite component are outliers,
    as are all rows where nothing falls into two parts of ``min_size`` (at least 2) rows.
    """
    if min_pts < 1 or min_size < 2:
        raise ValueError("min_pts must be 1 or more and min_size 2 or more")
    keyed = _directions(vectors)
    distinct = keyed.filter("unit is not null").groupBy("unit", "h1", "h2").agg(F.min("row_ix").alias("id"), F.count("*").alias("n"))
    distinct = materialise(distinct, "directions")
    n_points = distinct.count()
    if not n_points:
        return vectors.select("row_ix", F.lit(-1).cast("long").alias("cluster_id"))
    rows, links = joined_levels(distinct.select("id", "n", "unit"), n_points, min_pts, min_size)
    found = materialise(stable_clusters(*contracted(rows, links, min_size), min_size), "stable")
    sizes = found.groupBy("chosen").agg(F.sum("n").alias("size"), F.min("id").alias("first"))
    by_size = Window.orderBy(F.desc("size"), F.asc("first"))  # one row per cluster
    ids = sizes.select("chosen", (F.row_number().over(by_size) - 1).cast("long").alias("cluster_id"))
    named = found.join(ids, "chosen").join(distinct.select("id", "h1", "h2"), "id").select("h1", "h2", "cluster_id")
    members = keyed.select("row_ix", "h1", "h2").join(materialise(named, "named"), ["h1", "h2"], "left")
    return members.select("row_ix", F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"))


# --- description -----------------------------------------------------------------------


def topic_term_weights(docs: DataFrame, max_features: int = 2500) -> DataFrame:
    """``topic_id, term, f, idf, weight`` for ``row_ix, topic_id, tokens``, every topic read as one
    long document.

    weight = f(t,c) / F(c) * ln(1 + A / f(t)) over the ``max_features`` most frequent terms, where
    A is the mean number of words per topic, cut to a whole number (Grootendorst 2022).  Written
    out: it has at most topics x max_features rows and several readers.
    """
    words = docs.select("topic_id", F.explode("tokens").alias("term"))
    counts = words.groupBy("topic_id", "term").agg(F.count("*").alias("f"))
    totals = counts.groupBy("term").agg(F.sum("f").alias("f_all"))
    totals = totals.orderBy(F.desc("f_all"), F.asc("term")).limit(max_features)
    # max_features rows: a proven bound for the broadcast
    kept = materialise(counts.join(F.broadcast(totals), "term"), "topic_term_counts")
    lengths = kept.groupBy("topic_id").agg(F.sum("f").alias("f_topic"))
    n_topics = docs.agg(F.count_distinct("topic_id")).scalar()  # topics left without a term count too
    mean_length = F.floor(lengths.agg(F.sum("f_topic")).scalar() / n_topics)
    idf = F.log(1 + mean_length / F.col("f_all"))
    weights = kept.join(lengths, "topic_id").select(
        "topic_id", "term", "f", idf.alias("idf"), (F.col("f") / F.col("f_topic") * idf).alias("weight")
    )
    return materialise(weights, "topic_term_weights")


def ctfidf_terms(weights: DataFrame, top_n: int = 10) -> DataFrame:
    """Top terms of each topic from ``topic_term_weights``."""
    return topk_terms_per_topic(weights.select("topic_id", "term", "weight"), top_n)


def representative_rows(docs: DataFrame, weights: DataFrame, per_topic: int = 3) -> DataFrame:
    """``topic_id, row_ix, cosine, doc_rank``: rows whose weighted terms are closest to their topic's.

    Terms are counted inside each row and looked up by topic; a row's terms lie together, so the
    partial sums leave one record per row to shuffle.
    """
    norms = weights.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    table = materialise(weights.join(norms, "topic_id"), "weights_with_norm")
    mine = F.col("tf") * F.col("idf")
    cosine = F.try_divide(F.sum(mine * F.col("weight")), F.sqrt(F.sum(mine * mine)) * F.max("norm"))
    scored = (
        term_frequencies(docs.select("row_ix", "topic_id", "tokens"))
        .join(table, ["topic_id", "term"])
        .groupBy("row_ix", "topic_id")
        .agg(cosine.alias("cosine"))
    )
    # rounded, so that rows of equal text tie and the smaller row wins
    closest = Window.partitionBy("topic_id").orderBy(F.desc(F.round("cosine", 9)), F.asc("row_ix"))
    return scored.withColumn("doc_rank", F.row_number().over(closest)).filter(F.col("doc_rank") <= per_topic)


def topic_info(
    reviews: DataFrame, docs: DataFrame, weights: DataFrame, topic_terms: DataFrame,
    per_topic: int = 3, text_col: str = "review_full_text",
) -> DataFrame:
    """Per topic: size, ``{id}_{top four terms}``, term list, closest texts."""
    sizes = docs.groupBy("topic_id").agg(F.count("*").alias("n_reviews"))
    listed = topic_terms.groupBy("topic_id").agg(F.collect_list(F.struct("rank", "term")).alias("ranked"))
    closest = representative_rows(docs, weights, per_topic)
    closest = materialise(closest, "closest")
    texts = reviews.select("row_ix", text_col).join(closest, "row_ix")
    grouped = texts.groupBy("topic_id").agg(F.collect_list(F.struct("doc_rank", text_col)).alias("texts"))
    name = F.concat_ws("_", F.col("topic_id").cast("string"), joined_terms(F.col("ranked"), 4, "_"))
    return (
        sizes.join(listed, "topic_id", "left")
        .join(grouped, "topic_id", "left")
        .select(
            F.col("topic_id").alias("bertopic_topic_id"),
            "n_reviews",
            name.alias("Name"),
            F.transform(F.sort_array("ranked"), lambda x: x["term"]).alias("Representation"),
            F.transform(F.sort_array("texts"), lambda x: x[text_col]).alias("Representative_Docs"),
        )
        .orderBy("bertopic_topic_id")
    )


def topic_assign(df: DataFrame, assigned: DataFrame, topic_terms: DataFrame) -> DataFrame:
    """Attach cluster id and label to reviews; a topic without terms is labelled ``outlier``."""
    labels = topic_terms.select(
        F.col("topic_id").alias("bertopic_topic_id"), F.col("topic_label").alias("bertopic_topic_label")
    ).distinct()
    ids = assigned.select("row_ix", F.col("cluster_id").alias("bertopic_topic_id"))
    joined = df.join(ids, "row_ix", "left").join(labels, "bertopic_topic_id", "left")
    return joined.withColumn("bertopic_topic_label", F.coalesce("bertopic_topic_label", F.lit("outlier")))
