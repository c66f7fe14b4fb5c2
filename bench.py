"""Time the headline queries; prints one JSON line.

``stage_*`` entries time the stages a study writes out once (from raw tables, nothing cached);
the others time an operator that reads those stages.  Each operator runs once to warm up, then
``BENCH_RUNS`` times (default 3); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from registry.spark_queries import QUERIES, study

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

STAGES = ["scored", "tokens", "counts", "lda", "topic_weights", "vectors", "clusters", "cluster_terms", "reviews", "coherence"]
OPERATORS = [
    "clean_mojibake", "clean_whitespace", "redact_phone", "compose_full_text", "filter_sample", "dedupe_keep_first",
    "keyword_count", "dict_scores", "token_normalize", "doc_term_counts", "tfidf", "density_clusters",
    "topic_info", "rating_counts", "brand_summary", "sentiment_summary",
    "monthly_sentiment", "topic_distribution", "aspect_prevalence", "emotion_prevalence", "top_terms",
    "brand_summary_export", "sort_reviews", "representative_quotes", "manuscript_table", "rating_corr", "sink_table",
]


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    seconds: dict[str, float] = {}
    work = study(spark, SF_DIR)
    for stage in STAGES:
        start = time.perf_counter()
        getattr(work, stage)
        seconds[f"stage_{stage}"] = round(time.perf_counter() - start, 3)
    for name in OPERATORS:
        sink(QUERIES[name](spark, SF_DIR))
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            sink(QUERIES[name](spark, SF_DIR))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
