"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.params import EXPORT_COLUMNS, PUBLIC_COLUMNS


def _flat(df: DataFrame) -> DataFrame:
    """Zoned timestamps lose their zone (the session is UTC); arrays become JSON text for CSV."""
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def save_table(df: DataFrame, path: str, fmt: str = "csv", compression: str | None = None) -> None:
    """Write with a header, nulls as empty fields; parts stay parallel."""
    if fmt == "csv":
        writer = _flat(df).write.option("header", True).option("quote", '"').option("escape", '"')
        writer = writer.option("emptyValue", '""').option("nullValue", "")
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    else:
        writer = df.write
    if compression:
        writer = writer.option("compression", compression)
    writer.mode("overwrite").format(fmt).save(path)


def public_reviews(scored: DataFrame, columns: list[str] = PUBLIC_COLUMNS) -> DataFrame:
    """The columns that may be published: no reviewer name or contact."""
    return scored.select(*columns)


def save_compressed(df: DataFrame, path: str) -> None:
    save_table(df, path, "csv", "gzip")


def export_scored(scored: DataFrame, columns: dict[str, str] = EXPORT_COLUMNS) -> DataFrame:
    return scored.select(*[F.col(source).alias(name) for source, name in columns.items()])


def export_topic_distribution(distribution: DataFrame) -> DataFrame:
    return distribution.select(
        "brand", F.col("publication_label").alias("lda_topic_label"), "n_reviews", "pct_reviews"
    )


def export_aspect_distribution(distribution: DataFrame) -> DataFrame:
    return distribution.withColumnRenamed("aspect_top_category", "aspect_label")
