"""Reviews derived from ``documents``, and the dictionaries that fit its invented prose.

The published keyword lists hardly occur in that prose, so queries run with these instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewloom.params import Params
from reviewloom.sources.reviews import spread_small_input

REVIEW_COLUMNS = [
    "doc_id AS row_ix",
    """CASE n_chars % 7 WHEN 0 THEN 'H&M' WHEN 1 THEN 'HM' WHEN 2 THEN ' Zara' WHEN 3 THEN 'ZARA'
       WHEN 4 THEN 'Shein' WHEN 5 THEN 'URBAN OUTFITTERS' ELSE 'Other' END AS name""",
    "concat('u', cast(n_chars % 37 AS varchar(10))) AS reviewer_name",
    "concat('https://reviews.example/', cast(doc_id AS varchar(20))) AS url",
    "lang AS reviewer_country",
    "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE substr(text, 1, 40) END AS reviewer_title",
    "text AS reviewer_review",
    "CASE WHEN doc_id % 11 = 0 THEN 'n/a' ELSE cast(doc_id % 5 + 1 AS varchar(10)) END AS reviewer_rating",
    """CASE WHEN doc_id % 97 = 0 THEN 'unknown' ELSE concat('20', cast(20 + doc_id % 4 AS varchar(10)), '-',
       lpad(cast(doc_id % 12 + 1 AS varchar(10)), 2, '0'), '-', lpad(cast(doc_id % 28 + 1 AS varchar(10)), 2, '0')) END
       AS reviewer_published_date""",
    "concat(source, ' High Street') AS address",
    "concat('u', cast(n_chars % 37 AS varchar(10)), '@mail.example') AS email",
    "concat('+64 3 555 0', cast(100 + doc_id % 900 AS varchar(10))) AS phone",
]

ASPECTS = {
    "articles": ["the ", "thee"],
    "linking": ["and", "with"],
    "romance": ["que", "les", "para"],
    "german": ["und", "schen", "heit"],
    "rare": ["copyright", "license"],
}
EMOTIONS = {"joy": ["ing "], "calm": ["tion", "ation"], "fear": ["licen"]}

LABEL_RULES = [
    ("Germanic", ["und", "heit"]),
    ("Spanish", [" para ", " los "]),
    ("French", [" les ", "eaux"]),
    ("English", [" the ", "tion"]),
]

PARAMS = Params(
    aspects=ASPECTS,
    emotions=EMOTIONS,
    stopwords=["the", "of", "and", "to", "a", "in", "is", "und", "les"],
    custom_stopwords=["ar", "item", "wa"],
    stem_map={"thing": "item", "tion": "act", "ther": "other"},
    lexicon={"that": 1.5, "with": -1.2, "this": 0.8, "from": -2.1, "for": 0.4, "was": -0.9},
    negators=["not", "no", "is"],
    boosters={"and": 0.293, "of": -0.293},
    label_rules=LABEL_RULES,
    max_features=400,
    min_topic_size=20,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small_input(table(spark, sf_dir, "documents")).selectExpr(*REVIEW_COLUMNS)


#: Tables whose every value is compared after a round trip: name -> (registered query with the same rows, text columns,
#: number columns).  Text columns identify a row.
BUNDLE_TABLES = {
    "brand_summary": ("brand_summary", ["brand"], ["n_reviews", "mean_tokens", "median_tokens", "mean_compound"]),
    "rating_counts": ("rating_counts", ["brand", "reviewer_rating"], ["n_reviews"]),
    "sentiment_summary": ("sentiment_summary", ["brand", "sentiment_label"], ["n_reviews", "pct_reviews"]),
    "aspect_distribution_by_brand": ("aspect_prevalence", ["brand", "aspect_top_category"], ["n_reviews", "pct_reviews"]),
    "emotion_prevalence_by_brand": ("emotion_prevalence", ["brand", "emotion"], ["n_reviews", "pct_reviews"]),
    "monthly_sentiment_by_brand": ("monthly_sentiment", ["brand", "review_month"], ["mean_compound", "n_reviews"]),
    "top_terms_by_brand": ("top_terms", ["brand", "term"], ["rank", "count"]),
    "topic_distribution_by_brand": ("topic_distribution", ["brand", "dominant_topic_label", "publication_label"], ["n_reviews", "pct_reviews"]),
    "bertopic_distribution_by_brand": ("cluster_distribution", ["brand", "bertopic_topic_label"], ["n_reviews", "pct_reviews"]),
    "topic_terms": ("ctfidf_terms", ["topic_label", "term"], ["topic_id", "rank", "weight"]),
    "topic_coherence": ("coherence_compare", ["model", "topic_id", "topic_label"], ["coherence_cv"]),
    "construct_mapping": ("construct_union", ["model", "topic_id", "publication_label", "primary_construct", "interpretation"], []),
}
PUBLICATION_TABLES = {
    "Brand Summary": ("brand_summary_export", ["brand"], ["n_reviews", "mean_rating", "mean_sentiment", "pct_positive", "pct_negative", "pct_neutral"]),
    "LDA Topic Summary": ("topic_summary", ["publication_label", "top_words", "primary_construct", "interpretation"], ["topic_id", "coherence_cv_score"]),
    "LDA Representative Quotes": (
        "representative_quotes", ["publication_label", "brand", "quote_excerpt"],
        ["topic_id", "quote_rank", "reviewer_rating", "membership_score", "compound_sentiment"],
    ),
    "Study1 Manuscript Table": (
        "manuscript_table", ["lda_theme", "linked_construct", "top_words", "top_brands", "overall_top_aspects", "interpretation"],
        ["topic_id", "coherence_cv"],
    ),
    "Construct Mapping": ("construct_union", ["model", "topic_id", "publication_label", "primary_construct", "interpretation"], []),
}
