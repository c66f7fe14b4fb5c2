"""Labels and constructs: small lookups joined to topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.labels import mapped_label


def label_table(df: DataFrame, label_map: dict[int, str]) -> DataFrame:
    """A label map as a table ``topic_id, publication_label`` in the session of ``df``."""
    return df.sparkSession.createDataFrame(sorted(label_map.items()), "topic_id long, publication_label string")


def construct_table(df: DataFrame, key: str, kind: str, constructs: dict) -> DataFrame:
    rows = [(k, construct, text) for k, (construct, text) in constructs.items()]
    return df.sparkSession.createDataFrame(rows, f"{key} {kind}, primary_construct string, interpretation string")


def apply_labels(df: DataFrame, id_col: str, raw_col: str, labels: dict | DataFrame, out_col: str) -> DataFrame:
    """Label by id, falling back to the raw label.  A constant map is an expression; a table
    (first column key, second label) is a left join that Catalyst plans by its size."""
    if isinstance(labels, dict):
        return df.withColumn(out_col, mapped_label(F.col(id_col), F.col(raw_col), labels))
    key, label = labels.columns[:2]
    table = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    joined = df.join(table, F.col(id_col) == F.col("_key"), "left")
    return joined.withColumn(out_col, F.coalesce("_label", raw_col)).drop("_key", "_label")


def topic_distinct_labels(topic_terms: DataFrame) -> DataFrame:
    return topic_terms.select("topic_id", "topic_label").distinct()


def label_map_inverse(topic_terms: DataFrame, label_map: dict[int, str]) -> DataFrame:
    """``topic_label, publication_label``; if two topics share a label the higher id wins."""
    named = apply_labels(topic_distinct_labels(topic_terms), "topic_id", "topic_label", label_map, "publication_label")
    return named.groupBy("topic_label").agg(F.max_by("publication_label", "topic_id").alias("publication_label"))


def _with_constructs(df: DataFrame, model: str, topic_id) -> DataFrame:
    return df.select(
        F.lit(model).alias("model"),
        topic_id.alias("topic_id"),
        "publication_label",
        F.coalesce("primary_construct", F.lit("")).alias("primary_construct"),
        F.coalesce("interpretation", F.lit("")).alias("interpretation"),
    )


def construct_map_ids(labels: DataFrame, constructs: dict[int, tuple[str, str]], model: str = "LDA") -> DataFrame:
    """Construct and interpretation by topic id for ``topic_id, publication_label``."""
    table = construct_table(labels, "topic_id", "long", constructs)
    joined = labels.join(table, "topic_id", "left")
    return _with_constructs(joined, model, F.col("topic_id")).orderBy("topic_id")


def construct_map_labels(df: DataFrame, constructs: dict[str, tuple[str, str]], model: str = "BERTopic") -> DataFrame:
    """The same by label, over the sorted distinct ``publication_label`` of ``df``."""
    labels = df.select("publication_label").dropna().distinct()
    table = construct_table(df, "publication_label", "string", constructs)
    joined = labels.join(table, "publication_label", "left")
    return _with_constructs(joined, model, F.lit("")).orderBy("publication_label")


def construct_union(by_id: DataFrame, by_label: DataFrame) -> DataFrame:
    return by_id.withColumn("topic_id", F.col("topic_id").cast("string")).unionByName(by_label)
