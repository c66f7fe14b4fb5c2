"""A corpus pipeline: each stage works on all documents that the one before it kept.

Stages take (spark, docs, sf_dir) and return a table that is written as Parquet and read again as the next
one's documents.  All but the last keep the columns of ``documents``.  Decisions are made by doc_id: rows
that share an id share its fate, except that SimHash keeps one of them.  Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import language, packing, phrase_index, simhash, surrogates
from reviewloom.llm.queries import SURROGATE_KEY, tokenizer_file
from reviewloom.session import materialise, ship_package

#: Language predictions less probable than this are rejected, as is text without a language.
LEAST_SCORE = 0.35


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is in the written, narrow table ``gone``; ids may be null."""
    gone = gone.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one, so that names of extra columns meet no others."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(0)]).alias("row"))


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*[F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language with a score of ``LEAST_SCORE``, go.

    The model is fitted on the labelled documents that arrive, with the learning rows of the registered query;
    without any there is no language to reject by, and only texts without a letter go.
    """
    ship_package(spark)
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    kept = language.identify(_packed(docs), model, "row", "text")
    if model.languages:
        kept = kept.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    else:
        kept = kept.filter(F.col("text").rlike(r"\p{IsAlphabetic}"))
    return _unpacked(kept, docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, which names the group.

    Of rows that repeat an id one stays.  Rows without an id cannot be named, and stay.
    """
    ship_package(spark)
    found = materialise(simhash.near_duplicates(docs), "near_duplicates").filter("doc_id is not null")
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    lost = found.filter("doc_id <> component_id").select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    rest = _without(docs, materialise(lost, "lost"))
    repeated = materialise(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated_ids")
    if repeated.isEmpty():
        return rest
    return _without(rest, repeated).unionByName(rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship_package(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = materialise(phrase_index.contamination(docs, items).filter("n_hit > 0").select("doc_id"), "contaminated")
    return _without(docs, hit)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in every text; n_chars follows the new text."""
    ship_package(spark)
    new = surrogates.replace_entities(_packed(docs), SURROGATE_KEY, "row")
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
        new = new.withColumn("row", F.col("row").withField("n_chars", length))
    return _unpacked(new, docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    ship_package(spark)
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL states fitted models, XXH64 or a keyed hash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
