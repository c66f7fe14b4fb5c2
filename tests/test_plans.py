"""The plans are the ones meant: no Python per row, no all-pairs joins, no needless shuffles."""

import os
import re

import pytest
from pyspark.sql import functions as F

from registry import fixture as fx
from registry.spark_queries import QUERIES, FixtureStudy, study
from reviewloom.functions.sentiment import sentiment_scores
from reviewloom.operators import coherence as co
from reviewloom.operators import prepare as pr
from reviewloom.operators import tokens as tk
from reviewloom.session import materialise, materialise_stage, shared_folder

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", plan(df)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"density_clusters"}))
def test_no_python_and_no_all_pairs(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark):
    df = fx.table(spark, SF_DIR, "documents").selectExpr(*fx.REVIEW_COLUMNS)
    text = plan(df.select("row_ix", "name"))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text


def test_rating_filter_reaches_the_scan_side_of_cleaning(spark):
    raw = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr(*fx.REVIEW_COLUMNS)
    text = plan(pr.filter_sample(pr.standardise(raw, fx.PARAMS), fx.PARAMS))
    assert text.rindex("Filter") > text.index("Generate") and text.count("Generate") == 1
    # the text conditions stay above the pinned columns: cleaning runs once per row
    assert len(re.findall(r"regexp_replace\([^()]*REDACTED_PHONE", text)) <= 2


def test_dedupe_does_not_shuffle_texts(spark):
    raw = fx.reviews(spark, SF_DIR).selectExpr("*", "row_ix % 5 = 0 as again")
    keys = ["name", "reviewer_name", "reviewer_review"]
    twice = raw.unionByName(raw.filter("again").withColumn("row_ix", F.col("row_ix") + 1000))
    text = plan(pr.dedupe_keep_first(twice, keys))
    assert "LeftAnti" in text and "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "Window" not in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once = pr.dedupe_keep_first(raw.withColumn("name", F.col("row_ix").cast("string")), keys)
        assert "Exchange hashpartitioning" not in plan(once)  # without copies nothing moves
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_token_array_shuffles_compact_rows_once(spark):
    s = study(spark, SF_DIR)
    df = tk.token_array(s.sample, fx.PARAMS)
    text = plan(df)
    assert "BroadcastHashJoin" in text and "REPARTITION_BY_COL" in text
    # all tokens move once, by row; the other exchange is for hits of words that are not frequent
    moved = [line for line in text.splitlines() if re.search(r"\bExchange ", line)]
    assert len(moved) == 2 and sum("REPARTITION_BY_COL" in line for line in moved) == 1


def test_large_vocabulary_is_split(spark):
    """Only occurrences of rare words are shuffled by token, and nothing is lost."""
    s = study(spark, SF_DIR)
    expected = sorted((r.row_ix, tuple(r.tokens)) for r in s.tokens.collect())
    for bound in (1, 50, 2000):
        df = tk.token_array(s.sample, fx.PARAMS.with_(frequent_words=bound))
        assert sorted((r.row_ix, tuple(r.tokens)) for r in df.collect()) == expected
    text = plan(df)
    assert "LeftAnti" in text and "Join" in text


def test_frequent_tokens_are_not_exploded(spark):
    """Only the way of rare words has a row per token; that of all tokens keeps one row per review."""
    text = plan(tk.token_array(study(spark, SF_DIR).sample, fx.PARAMS))
    assert text.count("Generate posexplode") == 1 and "posexplode_outer" not in text


def test_coherence_sorts_no_occurrences(spark):
    s = study(spark, SF_DIR)
    text = plan(co.window_counts(s.tokens, co.word_sets(s.given_terms), 110))
    assert "Window" not in text and "Join" not in text


def test_given_topics_are_not_written_again(spark):
    s = study(spark, SF_DIR)
    assert s.given.inputFiles() == s.scored.inputFiles()


def test_term_counts_need_no_shuffle(spark):
    tokens = study(spark, SF_DIR).tokens
    assert exchanges(tk.term_frequencies(tokens)) == 0
    text = plan(tk.doc_term_counts(tokens, fx.PARAMS))
    assert "Exchange hashpartitioning(row_ix" not in text and "SortMergeJoin" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(row_ix", plan(tk.tfidf(tokens, fx.PARAMS)))) == 1


def test_coherence_windows_follow_the_row_partitioning(spark):
    s = study(spark, SF_DIR)
    df = co.window_counts(s.tokens, co.word_sets(s.given_terms), 110)
    text = plan(df)
    window_part = text[: text.index("inline(found")]
    # one shuffle for the final sums; the window sits on the partitioning by row_ix
    assert len(re.findall(r"Exchange hashpartitioning\(a", window_part)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(row_ix", text)) == 1


def test_sentiment_is_a_projection(spark):
    df = sentiment_scores(fx.reviews(spark, SF_DIR), "reviewer_review", fx.PARAMS.lexicon, fx.PARAMS.negators, fx.PARAMS.boosters)
    assert exchanges(df.select("row_ix", "compound")) <= 1  # only the spreading of a one-file input
    assert "Join" not in plan(df) and "Window" not in plan(df)


def test_top_k_is_cut_before_it_meets(spark):
    from reviewloom.operators.topics_lda import topk_terms_per_topic

    weights = spark.range(1000).select((F.col("id") % 3).alias("topic_id"), F.col("id").cast("string").alias("term"), F.rand(1).alias("weight"))
    assert plan(topk_terms_per_topic(weights, 10)).count("WindowGroupLimit") == 2


def test_brand_tables_shuffle_values_not_rows(spark):
    text = plan(QUERIES["rating_counts"](spark, SF_DIR))
    assert "partial_count" in text and "Join" not in text


def test_top_terms_do_not_shuffle_tokens(spark):
    text = plan(QUERIES["top_terms"](spark, SF_DIR))
    assert "SortMergeJoin" not in text and "partial_min" in text and "Exchange hashpartitioning(brand" in text
    assert "Exchange" not in text[text.index("posexplode"):].replace("BroadcastExchange", "")


def test_tables_on_the_way_to_a_stage_are_deleted(spark):
    def tables():
        return {f"{folder}/{name}" for folder, names, _ in os.walk(shared_folder(spark)) for name in names}

    before, s = tables(), FixtureStudy(fx.reviews(spark, SF_DIR), fx.PARAMS)
    rows = s.tokens.count(), s.clusters.count()
    left = {path.rsplit("/", 1)[1] for path in tables() - before}
    assert {"scored", "tokens", "counts", "vectors", "clusters"} <= left
    assert not left & {"cleaned", "later_copies", "raw_tokens", "vocabulary", "directions", "blocks", "marks", "links_and_nearest", "named"}
    assert rows == (s.scored.count(), s.scored.count())
    assert {"review_full_text"} == set(s.scored.columns) - set(spark.read.parquet(next(p for p in tables() - before if p.endswith("/scored"))).columns)
    # what was written before, or outside, stays
    outer = materialise(spark.range(3).toDF("a"), "outer")
    done = materialise_stage(lambda: materialise(outer, "inner").join(outer, "a"), "done")
    assert done.count() == outer.count() == 3 and s.tokens.count() == rows[0]


def test_shuffle_files_are_deleted_with_their_query(spark):
    df = spark.range(1000).repartition(5)
    first = df.collect()
    assert sorted(first) == sorted(df.collect())  # run again, though its files are gone
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
