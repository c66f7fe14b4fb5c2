"""One registered query for each operator of the subpackage, and the pipeline: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import (
    ball_tree, html_main, language, packing, periodic_runs, phrase_index, projection_forest, simhash, surrogates, token_alignment, toxicity, url_rules, warc,
)
from reviewloom.session import ship_package

#: Folder of the public tokenisers' module and files.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, verdict) of the rules that the registered query judges by (fixed values).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Key of the registered query's surrogates; a deployment passes its own secret.
SURROGATE_KEY = b"registered-query"


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), ball_tree.scaled(F.col("embedding")).alias("v"))
    return ball_tree.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.url_verdicts(_table(spark, sf_dir, "pages"), rules)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    listed = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(docs.filter("not held_out"))
    return language.identify(docs, model, "held_out")


def op7_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file())


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.replace_entities(_table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return found.select("doc_id", "text", "n_replaced")


def _bound(value, body):
    """``body`` of a lambda variable that holds ``value``, which is then evaluated once."""
    return F.transform(F.array(value), body)[0]


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; the words of every tenth text by CRC-32 of its id, from some word on, repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(words):
        n = F.size(words)
        first = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        period = 1 + F.floor((n - first) / (3 + g % 8)).cast("int")

        def repeated(at):
            return F.transform(F.sequence(F.lit(0), n - 1), lambda i: words[F.when(i < at["first"], i).otherwise(at["first"] + (i - at["first"]) % at["period"])])

        return F.when(n == 0, F.lit("")).otherwise(_bound(F.struct(first.alias("first"), period.alias("period")), lambda at: F.array_join(repeated(at), " ")))

    return docs.select("doc_id", F.when(h % 10 == 0, _bound(words, planted)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    # exact comparison of length / period; runs come by start, then period, and the first of equal ones stays
    greater = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda best, r: F.when(greater(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"), F.array_join(lines, "").alias("lines"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return projection_forest.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))[0]


QUERIES = {
    "op1_warc_capture_index": op1_warc_capture_index,
    "op2_html_main_text": op2_html_main_text,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_url_rules": op4_url_rules,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language_id": op6_language_id,
    "op7_toxicity_severity": op7_toxicity_severity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_projection_forest": op12_projection_forest,
    "op13_token_alignment": op13_token_alignment,
}
