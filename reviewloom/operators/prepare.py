"""From raw reviews to the analysed sample: one row per kept review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import text as tx
from reviewloom.functions.frames import computed_once
from reviewloom.params import Params
from reviewloom.session import TEXTS, materialise

CONTACT_COLUMNS = ["email", "phone"]
DEDUPE_KEYS = ["brand", "reviewer_name", "review_full_text"]


def clean_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add ``{out: in}`` cleaned and redacted.  One projection per step: a step that reads its
    input twice then reads a value, not the expression of all steps before it.

    Whitespace is collapsed once, before redaction: a mask replaces text that neither starts nor
    ends with whitespace, so masking leaves nothing to collapse.
    """
    df = df.withColumns({out: tx.clean_newlines(F.col(source)) for out, source in columns.items()})
    for step in (tx.clean_mojibake, tx.clean_whitespace, tx.redact_email, tx.redact_phone):
        df = df.withColumns({out: step(F.col(out)) for out in columns})
    return df


def standardise(df: DataFrame, params: Params) -> DataFrame:
    """Add brand, cleaned texts, rating, date, month and token count; a bad value becomes null."""
    texts = (
        clean_columns(df, {"review_text": "reviewer_review", "review_title": "reviewer_title"})
        .withColumn("review_full_text", tx.compose_full_text(F.col("review_title"), F.col("review_text")))
        .withColumn("token_count", tx.token_count(F.col("review_full_text")))
    )
    pinned = computed_once(texts, ["review_text", "review_title", "review_full_text", "token_count"])
    return pinned.withColumns(
        {
            "brand": tx.std_brand(F.col("name"), params.brand_synonyms),
            "reviewer_rating": tx.parse_rating(F.col("reviewer_rating")),
            "review_date": tx.parse_date(F.col("reviewer_published_date"), params.date_formats),
        }
    ).withColumn("review_month", tx.derive_month(F.col("review_date")))


def with_full_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Reviews that were written without ``review_full_text``, with it, in the order of ``columns``.  It repeats the title
    and the text, so written tables leave it out and readers put it together again."""
    return df.withColumn("review_full_text", tx.compose_full_text(F.col("review_title"), F.col("review_text"))).select(columns)


def filter_sample(df: DataFrame, params: Params) -> DataFrame:
    return df.filter(
        F.col("reviewer_rating").between(params.min_star, params.max_star)
        & (F.col("token_count") >= params.min_tokens)
        & (F.col("review_full_text") != "")
    )


def key_digest(keys: list[str]) -> Column:
    """SHA-256 of the key columns; nulls differ from empty text, and every part carries its own
    length, so that different keys cannot run together."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("n")) for k in keys]
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def dedupe_keep_first(df: DataFrame, keys: list[str], order: str = "row_ix", digest: Column | None = None) -> DataFrame:
    """First row, by ``order``, of each distinct key; nulls count as equal.

    Groups with copies are found by a partial-then-final aggregate over a digest of the keys, so a group of
    any size shrinks to one row per task before the shuffle, and long texts are not part of it.  Only the ids
    of later copies are then written, and rows with such an id left out: where copies are few, that table is
    small enough for Catalyst to broadcast, and the rows themselves do not move.
    """
    digest = key_digest(keys) if digest is None else digest
    narrow = df.select(digest.alias("_d"), F.col(order).alias("_o"))
    groups = narrow.groupBy("_d").agg(F.min("_o").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    copies = materialise(narrow.join(groups, "_d").filter("_o <> _first").select("_o"), "later_copies")
    return df if copies.isEmpty() else df.join(copies, F.col(order) == F.col("_o"), "left_anti")


def drop_contact_columns(df: DataFrame) -> DataFrame:
    return df.drop(*CONTACT_COLUMNS)


def brand_domain(df: DataFrame, brand_order: list[str]) -> DataFrame:
    """Unlisted brands become null; ``brand_ord`` is the declared position, from 1."""
    listed = F.when(F.col("brand").isin(brand_order), F.col("brand"))
    names = F.array(*[F.lit(b) for b in brand_order])
    return df.withColumn("brand", listed).withColumn(
        "brand_ord", F.array_position(names, F.col("brand")).cast("int")
    )


def review_order() -> list[Column]:
    """Declared brand, date, url, then input order; nulls last."""
    return [
        F.col("brand_ord").asc_nulls_last(),
        F.col("review_date").asc_nulls_last(),
        F.col("url").asc_nulls_last(),
        F.col("row_ix").asc(),
    ]


def order_key(*extra: Column) -> Column:
    """The same order as one comparable struct, for ``min`` and tie-breaking."""
    first = [
        F.col("brand_ord").isNull(), F.col("brand_ord"),
        F.col("review_date").isNull(), F.col("review_date"),
        F.col("url").isNull(), F.col("url"),
        F.col("row_ix"), *extra,
    ]
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(first)])


def sort_reviews(df: DataFrame) -> DataFrame:
    return df.orderBy(*review_order())


def prepare_reviews(df: DataFrame, params: Params) -> DataFrame:
    """The whole preparation.  Cleaned rows are written out once with the digest of their keys:
    cleaning is the expensive part, and the search for copies then reads two narrow columns."""
    sample = filter_sample(standardise(drop_contact_columns(df), params), params)
    keyed = sample.withColumn("_key", key_digest(DEDUPE_KEYS))
    cleaned = with_full_text(materialise(keyed.drop("review_full_text"), "cleaned", TEXTS), keyed.columns)
    kept = dedupe_keep_first(cleaned, DEDUPE_KEYS, digest=F.col("_key")).drop("_key")
    return brand_domain(kept, params.brand_order)
