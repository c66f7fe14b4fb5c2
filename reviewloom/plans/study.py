"""The study from raw reviews to named result tables.

Stages that several others read (the sample, the scores, the tokens, the topic assignments) are
written to the shared folder once and read from there; everything else stays lazy.  Tables that are
written only on the way to one stage are deleted once that stage is written.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.labels import first_match_label, sentiment_label
from reviewloom.functions.sentiment import sentiment_scores
from reviewloom.operators import coherence as co
from reviewloom.operators import labels as lb
from reviewloom.operators import prepare as pr
from reviewloom.operators import summaries as sm
from reviewloom.operators import tokens as tk
from reviewloom.operators import topics_cluster as tc
from reviewloom.operators import topics_lda as tl
from reviewloom.operators.dictionary import score_dictionary
from reviewloom.params import Params
from reviewloom.session import TEXTS, configure, materialise, materialise_stage
from reviewloom.sources import writers as wr
from reviewloom.sources.bundles import save_bundle


class Study:
    def __init__(self, raw: DataFrame, params: Params | None = None):
        configure(raw.sparkSession)
        self.raw = raw
        self.params = params or Params()

    # --- reviews -----------------------------------------------------------------------

    @cached_property
    def scored(self) -> DataFrame:
        """Cleaned, filtered, de-duplicated reviews with sentiment and dictionary scores.  Scoring
        is row-wise, so it is fused into the one write of the sample."""
        p = self.params
        columns: list[str] = []

        def plan() -> DataFrame:
            sample = pr.prepare_reviews(self.raw, p)
            df = sentiment_scores(sample, "review_full_text", p.lexicon, p.negators, p.boosters)
            label = sentiment_label(F.col("compound"), p.positive_threshold, p.negative_threshold)
            df = df.withColumn("sentiment_label", label)
            df = score_dictionary(df, p.aspects, "aspect")
            df = score_dictionary(df, p.emotions, "emotion")
            columns.extend(df.columns)
            return df.drop("review_full_text")

        return pr.with_full_text(materialise_stage(plan, "scored", TEXTS), columns)

    @cached_property
    def sample(self) -> DataFrame:
        """The reviews without their scores; a column subset of ``scored``."""
        scores = ["neg", "neu", "pos", "compound", "sentiment_label"]
        return self.scored.drop(*scores, *[c for c in self.scored.columns if c.startswith(("aspect_", "emotion_"))])

    @cached_property
    def tokens(self) -> DataFrame:
        """``row_ix, tokens`` with the brand and order columns, which arrive on the partitioning
        the tokens already have."""
        sample = self.sample
        keys = sample.select("row_ix", "brand", "brand_ord", "review_date", "url")
        return materialise_stage(lambda: tk.token_array(sample, self.params).join(keys, "row_ix"), "tokens")

    # --- topics ------------------------------------------------------------------------

    @cached_property
    def features(self) -> list[tuple[str, int]]:
        """Feature terms and the number of reviews with each; at most ``max_features``."""
        found = tk.feature_terms(self.tokens, self.params).orderBy("term_ix").select("term", "df").collect()
        return [(r.term, r.df) for r in found]

    @cached_property
    def terms(self) -> list[str]:
        return [term for term, _ in self.features]

    @cached_property
    def counts(self) -> DataFrame:
        return materialise(tl.count_vectors(self.tokens, self.terms), "counts")

    @cached_property
    def lda(self) -> tl.LdaModel:
        return tl.lda_fit(self.counts, self.params, len(self.terms))

    @cached_property
    def topic_terms(self) -> DataFrame:
        top = tl.lda_topic_terms(self.raw.sparkSession, self.lda, self.terms, self.params.top_words)
        labelled = lb.apply_labels(top, "topic_id", "topic_label", self.params.lda_labels, "publication_label")
        return materialise(labelled, "topic_terms")

    @cached_property
    def topic_weights(self) -> DataFrame:
        weights = tl.dominant_topic(tl.lda_weights(self.counts, self.lda), self.topic_terms)
        return materialise(weights, "topic_weights")

    @cached_property
    def vectors(self) -> DataFrame:
        weighted = tc.tfidf_vectors(self.counts, [df for _, df in self.features])
        rows, _ = tc.embed_svd(weighted, self.params.embedding_dim)
        return materialise(rows, "vectors")

    @cached_property
    def clusters(self) -> DataFrame:
        p, vectors = self.params, self.vectors

        def plan() -> DataFrame:
            if p.cluster_method == "hierarchy":
                return tc.hierarchical_clusters(vectors, p.min_pts, p.min_topic_size)
            if p.cluster_method == "reach":
                return tc.density_clusters(vectors, p.eps, p.min_pts, p.min_topic_size)
            raise ValueError(f"cluster_method is reach or hierarchy, not {p.cluster_method}")

        return materialise_stage(plan, "clusters")

    @cached_property
    def clustered(self) -> DataFrame:
        """``row_ix, topic_id, tokens``: the one join of tokens with their clusters."""
        ids = self.clusters.select("row_ix", F.col("cluster_id").alias("topic_id"))
        return materialise(self.tokens.select("row_ix", "tokens").join(ids, "row_ix"), "clustered")

    @cached_property
    def cluster_weights(self) -> DataFrame:
        return tc.topic_term_weights(self.clustered, self.params.max_features)

    @cached_property
    def cluster_terms(self) -> DataFrame:
        top = tc.ctfidf_terms(self.cluster_weights, self.params.cluster_top_words)
        label = first_match_label(F.col("topic_label"), self.params.label_rules)
        return materialise(top.withColumn("publication_label", label), "cluster_terms")

    @cached_property
    def cluster_info(self) -> DataFrame:
        info = tc.topic_info(self.sample, self.clustered, self.cluster_weights, self.cluster_terms)
        return info.withColumn("publication_label", first_match_label(F.col("Name"), self.params.label_rules))

    @cached_property
    def reviews(self) -> DataFrame:
        """Every scored review with its topics and labels."""
        p = self.params
        weights = self.topic_weights
        df = self.scored.join(weights, "row_ix", "left")
        df = tc.topic_assign(df, self.clusters, self.cluster_terms)
        df = lb.apply_labels(df, "dominant_topic_id", "dominant_topic_label", p.lda_labels, "dominant_topic_publication_label")
        label = first_match_label(F.col("bertopic_topic_label"), p.label_rules)
        df = df.withColumn("bertopic_topic_publication_label", label)
        return pr.with_full_text(materialise(df.drop("review_full_text"), "reviews", TEXTS), df.columns)

    @cached_property
    def coherence(self) -> DataFrame:
        scores = co.coherence_compare(
            self.topic_terms, self.clustered, self.cluster_terms, self.params.coherence_window
        )
        return materialise(scores, "coherence")

    # --- tables ------------------------------------------------------------------------

    @cached_property
    def topic_distribution(self) -> DataFrame:
        dist = sm.topic_distribution(self.reviews, self.params.brand_order)
        names = lb.label_map_inverse(self.topic_terms, self.params.lda_labels)
        return lb.apply_labels(dist, "dominant_topic_label", "dominant_topic_label", names, "publication_label")

    @cached_property
    def cluster_distribution(self) -> DataFrame:
        dist = sm.cluster_distribution(self.reviews, self.params.brand_order)
        label = first_match_label(F.col("bertopic_topic_label"), self.params.label_rules)
        return dist.withColumn("publication_label", label)

    @cached_property
    def construct_mapping(self) -> DataFrame:
        p = self.params
        by_id = lb.construct_map_ids(lb.label_table(self.topic_terms, p.lda_labels), p.lda_constructs)
        return lb.construct_union(by_id, lb.construct_map_labels(self.cluster_distribution, p.label_constructs))

    def tables(self) -> dict[str, DataFrame]:
        """The named result tables."""
        p, df = self.params, self.reviews
        return {
            "scored_reviews": pr.sort_reviews(tl.widen_weights(df, p.lda_topics)),
            "brand_summary": sm.brand_summary(df, p.brand_order),
            "rating_counts": sm.rating_counts(df, p.brand_order),
            "sentiment_summary": sm.sentiment_summary(df, p.brand_order),
            "topic_terms": self.topic_terms,
            "topic_distribution_by_brand": self.topic_distribution,
            "bertopic_terms": self.cluster_terms,
            "bertopic_info": self.cluster_info,
            "bertopic_distribution_by_brand": self.cluster_distribution,
            "construct_mapping": self.construct_mapping,
            "aspect_distribution_by_brand": sm.aspect_prevalence(df, p.brand_order),
            "emotion_prevalence_by_brand": sm.emotion_prevalence(df, list(p.emotions), p.brand_order),
            "monthly_sentiment_by_brand": sm.monthly_sentiment(df, p.brand_order),
            "topic_coherence": self.coherence,
            "top_terms_by_brand": sm.top_terms(self.tokens, p.brand_order),
        }

    def run(self, folder: str, fmt: str = "csv") -> dict[str, str]:
        """Write every table, the public projection, and its compressed copy, as one bundle."""
        public = wr.public_reviews(self.reviews)
        copies = {"study1_scored_reviews_public": public, "study1_scored_reviews_public_gz": public}
        return save_bundle(self.tables() | copies, folder, fmt, list(copies), ["study1_scored_reviews_public_gz"])
