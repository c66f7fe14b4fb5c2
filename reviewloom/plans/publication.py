"""The publication tables, from the written tables of a study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import report as rp
from reviewloom.operators import summaries as sm
from reviewloom.params import Params
from reviewloom.session import configure
from reviewloom.sources import writers as wr
from reviewloom.sources.bundles import open_bundle, save_bundle
from reviewloom.sources.reviews import load_scored, load_table

READS = [
    "topic_coherence", "construct_mapping", "topic_terms", "bertopic_terms",
    "topic_distribution_by_brand", "aspect_distribution_by_brand",
]


def publication_tables(scored: DataFrame, tables: dict[str, DataFrame], params: Params | None = None) -> dict[str, DataFrame]:
    """``scored`` holds ``topic_weights`` or the columns ``topic_0 ..``."""
    params = params or Params()
    if "topic_weights" not in scored.columns:
        wide = [F.col(f"topic_{i}") for i in range(params.lda_topics)]
        scored = scored.withColumn("topic_weights", F.array(*wide))
    scored = scored.withColumn("membership", F.get("topic_weights", F.col("dominant_topic_id").cast("int")))
    coherence, constructs = tables["topic_coherence"], tables["construct_mapping"]
    lda = rp.topic_summary(tables["topic_terms"], coherence, constructs, "LDA")
    in_cluster = tables["bertopic_terms"].filter(F.col("topic_id") != -1)
    aspects = tables["aspect_distribution_by_brand"]
    topics = tables["topic_distribution_by_brand"]
    return {
        "Scored Reviews": wr.export_scored(scored),
        "Brand Summary": sm.brand_summary_export(scored),
        "LDA Topic Summary": lda,
        "BERTopic Summary": rp.topic_summary(in_cluster, coherence, constructs, "BERTopic"),
        "Topic Distribution": wr.export_topic_distribution(topics),
        "Aspect Distribution": wr.export_aspect_distribution(aspects),
        "LDA Representative Quotes": rp.representative_quotes(scored, lda, order=["brand_ord", "review_date", "url"]),
        "Study1 Manuscript Table": rp.manuscript_table(lda, topics, aspects, params.brand_order),
        "Construct Mapping": constructs,
    }


def export_publication(spark: SparkSession, folder: str, out: str, params: Params | None = None, scored: DataFrame | None = None) -> dict[str, str]:
    """Re-read the study's tables from the bundle in ``folder`` and write the publication bundle to ``out``.

    Pass ``Study.reviews`` as ``scored`` where it is at hand: it saves parsing the reviews again.
    """
    configure(spark)
    params = params or Params()
    read = READS if scored is not None else [*READS, "scored_reviews"]
    at = open_bundle(spark, folder, check=read)
    tables = {name: load_table(spark, at, name) for name in READS}
    scored = load_scored(spark, at, params) if scored is None else scored
    return save_bundle(publication_tables(scored, tables, params), out)
