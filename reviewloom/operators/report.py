"""Report tables built from results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import percent_text, quote_excerpt
from reviewloom.operators.topics_lda import joined_terms

QUOTE_MIN_LENGTH = 80
QUOTE_LENGTH = 600
QUOTE_IDEAL_TOKENS = 70


def _share_line(name: str) -> Column:
    return F.concat(F.col(name), F.lit(" ("), percent_text(F.col("pct_reviews")), F.lit(")"))


def _top_lines(df: DataFrame, group: str, name: str, order: list[Column], n: int, out: str) -> DataFrame:
    """``n`` first rows of each group as one text ``name (x.x%); ...``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    top = df.withColumn("_r", rank).filter(F.col("_r") <= n).withColumn("_t", _share_line(name))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"])
    return top.groupBy(group).agg(F.array_join(lines, "; ").alias(out))


def topk_brands_per_topic(distribution: DataFrame, brand_order: list[str], n: int = 2) -> DataFrame:
    """``publication_label, top_brands``; equal shares in declared brand order."""
    names = F.array(*[F.lit(b) for b in brand_order])
    order = [F.desc_nulls_last("pct_reviews"), F.array_position(names, F.col("brand"))]
    return _top_lines(distribution, "publication_label", "brand", order, n, "top_brands")


def topk_aspects_per_brand(distribution: DataFrame, n: int = 2) -> DataFrame:
    order = [F.desc_nulls_last("pct_reviews"), F.asc("aspect_top_category")]
    return _top_lines(distribution, "brand", "aspect_top_category", order, n, "top_aspects")


def overall_top_aspects(distribution: DataFrame, n: int = 3) -> DataFrame:
    """One row: the aspects most frequent over all brands, as text."""
    counts = distribution.groupBy("aspect_top_category").agg(F.sum("n_reviews").alias("n_reviews"))
    total = counts.agg(F.sum("n_reviews")).scalar()
    top = counts.withColumn("pct_reviews", F.try_divide(100.0 * F.col("n_reviews"), total))
    top = top.orderBy(F.desc("pct_reviews"), F.asc("aspect_top_category")).limit(n)
    key = F.struct((-F.col("pct_reviews")).alias("k"), F.col("aspect_top_category").alias("a"), _share_line("aspect_top_category").alias("t"))
    lines = F.transform(F.sort_array(F.collect_list(key)), lambda x: x["t"])
    return top.agg(F.array_join(lines, "; ").alias("overall_top_aspects"))


def topic_summary(topic_terms: DataFrame, coherence: DataFrame, constructs: DataFrame, model: str, n: int = 10) -> DataFrame:
    """Top words, coherence and construct of each labelled topic of one model."""
    listed = topic_terms.groupBy("topic_id", "publication_label").agg(F.collect_list(F.struct("rank", "term")).alias("r"))
    words = listed.select("topic_id", "publication_label", joined_terms(F.col("r"), n, ", ").alias("top_words"))
    scores = coherence.filter((F.col("model") == model) & (F.col("topic_id") != "overall")).select(
        F.col("topic_id").try_cast("long").alias("topic_id"), F.col("coherence_cv").alias("coherence_cv_score")
    )
    linked = constructs.filter(F.col("model") == model).select("publication_label", "primary_construct", "interpretation")
    return words.join(scores, "topic_id", "left").join(linked, "publication_label", "left").select(
        "topic_id", "publication_label", "top_words", "coherence_cv_score", "primary_construct", "interpretation"
    ).orderBy("topic_id", "publication_label")


def representative_quotes(
    scored: DataFrame, summary: DataFrame, per_topic: int = 2, order: list[str] | None = None
) -> DataFrame:
    """The ``per_topic`` best quotes of every topic in ``summary``.

    ``scored`` has ``membership``, the weight of its dominant topic.  Best is: strongest
    membership, length nearest 70 tokens, lowest compound, then ``order``.  Equal texts count
    once: the best of them is found by a partial-then-final ``min`` on a text digest, so copies
    collapse inside each task.  Texts are only fetched for the rows that win.
    """
    ties = [F.col(c) for c in (order or ["row_ix"])]
    best = F.struct(
        (-F.col("membership")).alias("k0"),
        F.abs(F.col("token_count") - QUOTE_IDEAL_TOKENS).alias("k1"),
        F.col("compound").alias("k2"),
        *[k.alias(f"k{j}") for j, k in enumerate((x for c in ties for x in (c.isNull(), c)), start=3)],
        F.col("row_ix").alias("row_ix"),
    )
    quotable = scored.filter(F.length(F.trim("review_full_text")) >= QUOTE_MIN_LENGTH)
    distinct = (
        quotable.select(F.col("dominant_topic_id").alias("topic_id"), F.sha2("review_full_text", 256).alias("_text"), best.alias("_best"))
        .groupBy("topic_id", "_text")
        .agg(F.min("_best").alias("_best"))
    )
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy("_best"))
    winners = (
        distinct.withColumn("quote_rank", rank.cast("long"))
        .filter(F.col("quote_rank") <= per_topic)
        .select("topic_id", "quote_rank", F.col("_best.row_ix").alias("row_ix"))
    )
    labels = summary.select("topic_id", "publication_label").distinct()
    # per_topic rows per topic
    chosen = F.broadcast(winners.join(labels, "topic_id"))
    return scored.join(chosen, "row_ix").select(
        "topic_id", "publication_label", "quote_rank", "brand", "reviewer_rating",
        F.bround("membership", 4).alias("membership_score"),
        F.bround("compound", 4).alias("compound_sentiment"),
        quote_excerpt(F.col("review_full_text"), QUOTE_LENGTH).alias("quote_excerpt"),
    ).orderBy("topic_id", "quote_rank")


def manuscript_table(summary: DataFrame, topic_distribution: DataFrame, aspect_distribution: DataFrame, brand_order: list[str]) -> DataFrame:
    brands = topk_brands_per_topic(topic_distribution, brand_order)
    overall = overall_top_aspects(aspect_distribution).scalar()
    return summary.join(brands, "publication_label", "left").select(
        "topic_id",
        F.col("publication_label").alias("lda_theme"),
        F.col("primary_construct").alias("linked_construct"),
        F.col("coherence_cv_score").alias("coherence_cv"),
        "top_words",
        "top_brands",
        overall.alias("overall_top_aspects"),
        "interpretation",
    ).orderBy("topic_id")
