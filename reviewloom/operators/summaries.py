"""Brand-level summary tables.

Grouping by brand alone would send a whole brand to one task.  Every table here aggregates first
(partial, then final) into a few rows per distinct value, and only those rows see a window.
The zero-filled grid costs no join: one conditional aggregate per brand is turned into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.prepare import order_key
from reviewloom.session import materialise


def exact_sum(score: Column) -> Column:
    """Sum of scores in decimals: the same in whatever order rows arrive, retries included."""
    return F.sum(score.cast("decimal(20,10)"))


def exact_mean(score: Column) -> Column:
    return F.try_divide(exact_sum(score).cast("double"), F.count(score))


def zero_fill(df: DataFrame, value_cols: list[str], brand_order: list[str], measures: dict[str, "callable"]) -> DataFrame:
    """Every declared brand x every value seen, with ``measures[name](is_this_brand)`` aggregated.

    Values seen only under an undeclared brand count as seen; null values do not.
    """
    known = df.dropna(subset=value_cols)
    aggregates, cells = [], []
    for i, brand in enumerate(brand_order):
        here = F.col("brand") == brand
        parts = [F.lit(brand).alias("brand"), F.lit(i + 1).alias("brand_ord")]
        for name, make in measures.items():
            aggregates.append(make(here).alias(f"{name}_{i}"))
            parts.append(F.col(f"{name}_{i}").alias(name))
        cells.append(F.struct(*parts))
    wide = known.groupBy(*value_cols).agg(*aggregates)
    return wide.select(*value_cols, F.inline(F.array(*cells)))


def counts_of(df: DataFrame, value_cols: list[str], brand_order: list[str]) -> DataFrame:
    return zero_fill(df, value_cols, brand_order, {"n_reviews": F.count_if})


def pct_of_group(df: DataFrame, group: str = "brand", count_col: str = "n_reviews") -> DataFrame:
    """Add ``pct_reviews``; null where the group is empty.  For already aggregated rows."""
    total = F.sum(count_col).over(Window.partitionBy(group))
    return df.withColumn("pct_reviews", F.try_divide(100.0 * F.col(count_col), total))


def sort_dist(df: DataFrame, label: str) -> DataFrame:
    """Brands in declared order, shares descending, equal shares by label."""
    return df.orderBy("brand_ord", F.desc_nulls_last("pct_reviews"), label)


def rating_counts(df: DataFrame, brand_order: list[str]) -> DataFrame:
    out = counts_of(df, ["reviewer_rating"], brand_order).orderBy("brand_ord", "reviewer_rating")
    return out.select("brand", "reviewer_rating", "n_reviews")


def brand_rows(df: DataFrame, brand_order: list[str]) -> DataFrame:
    """One row per declared brand: left join of the brand list with per-brand aggregates."""
    spark = df.sparkSession
    brands = spark.createDataFrame([(b, i + 1) for i, b in enumerate(brand_order)], "brand string, brand_ord int")
    return brands.join(df, "brand", "left")


def brand_summary(df: DataFrame, brand_order: list[str]) -> DataFrame:
    """Count, mean and exact median tokens, mean compound.  The median is taken over the
    histogram of token counts, which is small however many reviews a brand has."""
    histogram = df.groupBy("brand", "token_count").agg(
        F.count("*").alias("n"), exact_sum(F.col("compound")).alias("s")
    )
    n = F.sum("n")
    per_brand = histogram.groupBy("brand").agg(
        n.alias("n_reviews"),
        (F.sum(F.col("n") * F.col("token_count")) / n).alias("mean_tokens"),
        F.percentile("token_count", 0.5, F.col("n")).alias("median_tokens"),
        (F.sum("s").cast("double") / n).alias("mean_compound"),
    )
    out = brand_rows(per_brand, brand_order).orderBy("brand_ord")
    return out.select("brand", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"), "mean_tokens", "median_tokens", "mean_compound")


def share_table(df: DataFrame, label: str, brand_order: list[str]) -> DataFrame:
    """Count and share of each brand's reviews by an exclusive label, zero-filled and sorted."""
    shares = pct_of_group(counts_of(df, [label], brand_order))
    return sort_dist(shares, label).select("brand", label, "n_reviews", "pct_reviews")


def sentiment_summary(df: DataFrame, brand_order: list[str]) -> DataFrame:
    shares = pct_of_group(counts_of(df, ["sentiment_label"], brand_order))
    return shares.orderBy("brand_ord", "sentiment_label").select("brand", "sentiment_label", "n_reviews", "pct_reviews")


def topic_distribution(df: DataFrame, brand_order: list[str]) -> DataFrame:
    return share_table(df, "dominant_topic_label", brand_order)


def cluster_distribution(df: DataFrame, brand_order: list[str]) -> DataFrame:
    """Outliers leave before the shares are taken."""
    return share_table(df.filter(F.col("bertopic_topic_id") != -1), "bertopic_topic_label", brand_order)


def aspect_prevalence(df: DataFrame, brand_order: list[str]) -> DataFrame:
    return share_table(df, "aspect_top_category", brand_order)


def monthly_sentiment(df: DataFrame, brand_order: list[str]) -> DataFrame:
    """Mean compound and count by brand and month; undated reviews are left out."""
    dated = df.filter(F.col("review_date").isNotNull())
    measures = {"n_reviews": F.count_if, "mean_compound": lambda here: exact_mean(F.when(here, F.col("compound")))}
    out = zero_fill(dated, ["review_month"], brand_order, measures)
    return out.orderBy("brand_ord", "review_month").select("brand", "review_month", "mean_compound", "n_reviews")


def emotion_prevalence(df: DataFrame, emotions: list[str], brand_order: list[str]) -> DataFrame:
    """Multi-label: share of a brand's reviews with any hit of each emotion; 0 for an empty brand.
    Brands are in alphabetical order here."""
    hits = [F.count_if(F.col(f"emotion_{e}") > 0).alias(f"n{i}") for i, e in enumerate(emotions)]
    per_brand = df.groupBy("brand").agg(F.count("*").alias("total"), *hits)
    filled = brand_rows(per_brand, brand_order).na.fill(0)
    cells = [F.struct(F.lit(e).alias("emotion"), F.col(f"n{i}").alias("n_reviews")) for i, e in enumerate(emotions)]
    rows = filled.select("brand", "total", F.inline(F.array(*cells)))
    pct = F.coalesce(F.try_divide(100.0 * F.col("n_reviews"), F.col("total")), F.lit(0.0))
    out = rows.withColumn("pct_reviews", pct).orderBy("brand", F.desc("pct_reviews"), "emotion")
    return out.select("brand", "emotion", "n_reviews", "pct_reviews")


def top_terms(docs: DataFrame, brand_order: list[str], top_n: int = 20) -> DataFrame:
    """Most frequent terms longer than three letters by brand; the first seen wins a tie.

    ``docs`` holds ``tokens`` beside the columns of ``order_key``.  Counts are partial per task,
    and the rank filter cuts each task's terms before they meet.  The terms that reach ``top_n``,
    ties included, are written out, so that the second pass, which looks up where they were first
    seen, joins a table of known size and need not shuffle tokens.
    """
    listed = docs.filter(F.col("brand").isin(brand_order))
    words = listed.select("brand", F.explode("tokens").alias("term")).filter(F.length("term") > 3)
    counts = words.groupBy("brand", "term").agg(F.count("*").alias("count"))
    by_count = Window.partitionBy("brand").orderBy(F.desc("count"))
    leaders = counts.withColumn("_r", F.rank().over(by_count)).filter(F.col("_r") <= top_n).drop("_r")
    leaders = materialise(leaders, "leading_terms")
    keys = ["brand", "brand_ord", "review_date", "url", "row_ix"]
    placed = listed.select(*keys, F.posexplode("tokens").alias("pos", "term")).join(leaders, ["brand", "term"])
    first = placed.groupBy("brand", "brand_ord", "term", "count").agg(F.min(order_key(F.col("pos"))).alias("seen"))
    by_rank = Window.partitionBy("brand").orderBy(F.desc("count"), F.asc("seen"))
    ranked = first.withColumn("rank", F.row_number().over(by_rank).cast("long")).filter(F.col("rank") <= top_n)
    return ranked.orderBy("brand_ord", "rank").select("brand", "rank", "term", "count")


def round_columns(df: DataFrame, columns: list[str], places: int = 3) -> DataFrame:
    """Half-even rounding."""
    return df.withColumns({c: F.bround(c, places) for c in columns})


ROUNDED = ["mean_rating", "mean_sentiment", "pct_positive", "pct_negative", "pct_neutral"]


def brand_summary_export(df: DataFrame) -> DataFrame:
    """Count, mean rating and sentiment, and sentiment shares of the brands present, one pass."""

    def is_label(name: str) -> Column:
        return F.col("sentiment_label") == name

    labels = ["positive", "negative", "neutral"]
    per_brand = df.filter(F.col("brand").isNotNull()).groupBy("brand").agg(
        F.count("*").alias("n_reviews"),
        F.avg("reviewer_rating").alias("mean_rating"),
        exact_mean(F.col("compound")).alias("mean_sentiment"),
        *[F.count_if(is_label(x)).alias(f"n_{x}") for x in labels],
    )
    total = sum((F.col(f"n_{x}") for x in labels[1:]), F.col(f"n_{labels[0]}"))
    shares = {f"pct_{x}": F.try_divide(100.0 * F.col(f"n_{x}"), total) for x in labels}
    out = per_brand.withColumns(shares).drop(*[f"n_{x}" for x in labels])
    return round_columns(out, ROUNDED).orderBy("brand")
