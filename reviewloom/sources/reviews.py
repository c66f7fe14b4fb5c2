"""Reading reviews, result tables and lexicons.  Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.sentiment import MAX_LEXICON
from reviewloom.params import Params
from reviewloom.sources.bundles import current_folder
from reviewloom.sources.split_csv import read_split_csv

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


REVIEW_SCHEMA = _schema(
    row_ix=_L, name=_S, address=_S, url=_S, reviewer_name=_S, reviewer_country=_S, reviewer_title=_S,
    reviewer_review=_S, reviewer_rating=_S, reviewer_published_date=_S, email=_S, phone=_S,
)

TABLE_SCHEMAS = {
    "rating_counts": _schema(brand=_S, reviewer_rating=_D, n_reviews=_L),
    "brand_summary": _schema(brand=_S, n_reviews=_L, mean_tokens=_D, median_tokens=_D, mean_compound=_D),
    "sentiment_summary": _schema(brand=_S, sentiment_label=_S, n_reviews=_L, pct_reviews=_D),
    "monthly_sentiment_by_brand": _schema(brand=_S, review_month=T.DateType(), mean_compound=_D, n_reviews=_L),
    "aspect_distribution_by_brand": _schema(brand=_S, aspect_top_category=_S, n_reviews=_L, pct_reviews=_D),
    "emotion_prevalence_by_brand": _schema(brand=_S, emotion=_S, n_reviews=_L, pct_reviews=_D),
    "topic_distribution_by_brand": _schema(brand=_S, dominant_topic_label=_S, n_reviews=_L, pct_reviews=_D, publication_label=_S),
    "bertopic_distribution_by_brand": _schema(brand=_S, bertopic_topic_label=_S, n_reviews=_L, pct_reviews=_D, publication_label=_S),
    "topic_terms": _schema(topic_id=_L, topic_label=_S, rank=_L, term=_S, weight=_D, publication_label=_S),
    "bertopic_terms": _schema(topic_id=_L, topic_label=_S, rank=_L, term=_S, weight=_D, publication_label=_S),
    "topic_coherence": _schema(model=_S, topic_id=_S, topic_label=_S, coherence_cv=_D),
    "construct_mapping": _schema(model=_S, topic_id=_S, publication_label=_S, primary_construct=_S, interpretation=_S),
    "top_terms_by_brand": _schema(brand=_S, rank=_L, term=_S, count=_L),
}

# With a null marker no field can hold, an empty field is null and a quoted empty field is "".
CSV_READ = {
    "header": True, "multiLine": True, "quote": '"', "escape": '"', "enforceSchema": False,
    "nullValue": chr(0), "emptyValue": "",
}
CSV_PARSE = {k: v for k, v in CSV_READ.items() if k in ("quote", "escape", "nullValue", "emptyValue")}


def load_reviews(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = REVIEW_SCHEMA, line_breaks: bool = True,
    strict_quotes: bool = True,
) -> DataFrame:
    """Raw reviews from parquet, CSV or JSON; a missing path raises.

    ``row_ix`` is the input order and must be a column of parquet and JSON sources.  CSV columns are found by
    their name in the header, which all files share; others are ignored, missing ones null.  Without a
    ``row_ix`` rows are numbered by file name and position.  Fields may hold line breaks, and large files are read in
    splits all the same (``split_csv``, which passes over the files twice and writes the records once).  With
    ``line_breaks`` False no field may hold one, and no pass is needed.  With ``strict_quotes`` False quotes may stand
    inside unquoted fields; a file is then read in one task.
    """
    if fmt != "csv":
        return spread_small_input(spark.read.schema(schema).format(fmt).load(path))
    options = CSV_READ | {"multiLine": line_breaks}
    names = spark.read.options(**options).csv(path).columns
    column = lambda prefix, f: (F.col(f"{prefix}`{f.name}`") if f.name in names else F.lit(None)).try_cast(f.dataType).alias(f.name)
    if line_breaks and strict_quotes:
        rows = read_split_csv(spark, path, names, CSV_PARSE)
        number = [] if "row_ix" in names else [F.col("row_ix")]
        return spread_small_input(rows.select(*number, *[column("row.", f) for f in schema if not number or f.name != "row_ix"]).select([f.name for f in schema]))
    rows = spark.read.options(**options).schema(T.StructType([T.StructField(n, _S) for n in names])).csv(path)
    columns = [column("", f) for f in schema]
    if "row_ix" in names:
        return spread_small_input(rows.select(*columns))
    return spread_small_input(_numbered(rows.select(*columns, "_metadata.file_path", "_metadata.file_block_start")))


def _numbered(rows: DataFrame) -> DataFrame:
    """``row_ix`` by file, split of the file, and position in the split; a count of each split is all that moves."""
    where = ["file_path", "file_block_start"]
    placed = rows.withColumn("_at", F.monotonically_increasing_id())  # rising within a split
    splits = placed.groupBy(*where).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy(*where).rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = splits.select(*where, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    numbered = placed.join(splits, where).withColumn("row_ix", F.col("_base") + F.col("_at") - F.col("_first"))
    return numbered.select(rows.drop(*where).columns)


def spread_small_input(df: DataFrame) -> DataFrame:
    """Give every core work when the input is read in fewer splits than there are cores.  A large
    input has many more splits than that, and is left as it is: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """One result table written by ``sources.writers`` or in a bundle, read back under its declared schema."""
    path = f"{current_folder(spark, folder)}/{name}"
    return spark.read.options(**CSV_READ).schema(schema or TABLE_SCHEMAS[name]).csv(path)


def load_scored(spark: SparkSession, folder: str, params: Params) -> DataFrame:
    """The written ``scored_reviews``: names come from its header, as raw columns vary; the types
    of the columns that a study adds are declared here."""
    types = {
        "row_ix": _L, "reviewer_rating": _D, "review_date": T.TimestampType(), "review_month": T.DateType(),
        "token_count": _L, "brand_ord": T.IntegerType(), "dominant_topic_id": _L, "bertopic_topic_id": _L,
    }
    types |= {name: _D for name in ("neg", "neu", "pos", "compound")}
    types |= {f"topic_{i}": _D for i in range(params.lda_topics)}
    types |= {f"aspect_{c}": _L for c in params.aspects} | {f"emotion_{c}": _L for c in params.emotions}
    path = f"{current_folder(spark, folder)}/scored_reviews"
    df = read_split_csv(spark, path, spark.read.options(**CSV_READ).csv(path).columns, CSV_PARSE).select("row.*")
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def read_lexicon(spark: SparkSession, path: str) -> dict[str, float]:
    """A valence lexicon: tab-separated ``word, valence`` lines, further columns ignored.

    It becomes a constant of the scoring expressions, so its size is checked while reading.
    """
    lines = spark.read.schema(_schema(word=_S, valence=_D)).option("sep", "\t").option("quote", "").csv(path)
    rows = lines.dropna().limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"lexicon has more than {MAX_LEXICON} entries")
    return {r.word: r.valence for r in rows}


def dictionary_table(spark: SparkSession, params: Params) -> DataFrame:
    """The keyword dictionaries as rows ``group_name, category, category_ord, keyword``."""
    groups = {"aspect": params.aspects, "emotion": params.emotions}
    rows = [
        (group, category, i, keyword)
        for group, categories in groups.items()
        for i, (category, keywords) in enumerate(categories.items(), start=1)
        for keyword in keywords
    ]
    return spark.createDataFrame(rows, "group_name string, category string, category_ord long, keyword string")
