"""Keyword-category scores per review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.frames import computed_once
from reviewloom.functions.keywords import keyword_count, padded_lower, top_category


def dict_scores(df: DataFrame, categories: dict[str, list[str]], prefix: str, text_col: str = "review_full_text") -> DataFrame:
    """Add one count column ``{prefix}_{category}`` per category, in declared order."""
    counts = {f"{prefix}_{c}": keyword_count(F.col("_padded"), words) for c, words in categories.items()}
    scored = df.withColumn("_padded", padded_lower(F.col(text_col))).withColumns(counts).drop("_padded")
    return computed_once(scored, list(counts))


def dict_top_category(df: DataFrame, categories: list[str], prefix: str) -> DataFrame:
    scores = {c: F.col(f"{prefix}_{c}") for c in categories}
    return df.withColumn(f"{prefix}_top_category", top_category(scores))


def score_dictionary(df: DataFrame, categories: dict[str, list[str]], prefix: str) -> DataFrame:
    return dict_top_category(dict_scores(df, categories, prefix), list(categories), prefix)
