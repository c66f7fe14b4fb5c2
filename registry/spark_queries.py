"""One registered query per operator, each over the whole given tables.

``study(...)`` holds the stages that a study writes out once and many operators read.  Topic
operators whose models have no SQL answer are checked on given topics: the review's language.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry import fixture as fx
from reviewloom.functions import keywords as kw
from reviewloom.functions import labels as fl
from reviewloom.functions import text as tx
from reviewloom.operators import charts as ch
from reviewloom.operators import coherence as co
from reviewloom.operators import dictionary as dc
from reviewloom.operators import labels as lb
from reviewloom.operators import prepare as pr
from reviewloom.operators import report as rp
from reviewloom.operators import summaries as sm
from reviewloom.operators import tokens as tk
from reviewloom.operators import topics_cluster as tc
from reviewloom.operators import topics_lda as tl
from reviewloom.params import english_stopwords
from reviewloom.plans import publication as pb
from reviewloom.plans.publication import export_publication
from reviewloom.plans.study import Study
from reviewloom.session import TEXTS, configure, materialise, scratch_path
from reviewloom.sources import writers as wr
from reviewloom.sources.bundles import open_bundle, save_bundle
from reviewloom.sources.reviews import dictionary_table, load_reviews, load_table

P = fx.PARAMS
BRANDS = P.brand_order
EMOTIONS = list(P.emotions)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


class FixtureStudy(Study):
    """The study of the derived reviews, plus the given topics."""

    @cached_property
    def given(self) -> DataFrame:
        """Scored reviews with topic and cluster ids by language, and a given membership: row-wise on the written
        scores, so readers of a few columns read only those."""
        lang = F.col("reviewer_country")
        topic = F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(3)
        cluster = F.when(lang == "de", 1).when(lang == "en", 0).when(lang == "es", -1).otherwise(2)
        return self.scored.withColumns(
            {
                "dominant_topic_id": topic.cast("long"),
                "cluster_id": cluster.cast("long"),
                "membership": (50 + F.col("token_count") % 50) / 100.0,
            }
        )

    def tokens_by(self, topic: str) -> DataFrame:
        topics = self.given.select("row_ix", F.col(topic).alias("topic_id"))
        return self.tokens.select("row_ix", "tokens").join(topics, "row_ix")

    @cached_property
    def given_weights(self) -> DataFrame:
        return tc.topic_term_weights(self.tokens_by("dominant_topic_id"), P.max_features)

    @cached_property
    def given_terms(self) -> DataFrame:
        top = tc.ctfidf_terms(self.given_weights, P.top_words)
        labelled = lb.apply_labels(top, "topic_id", "topic_label", P.lda_labels, "publication_label")
        return materialise(labelled, "given_terms")

    @cached_property
    def given_clustered(self) -> DataFrame:
        return materialise(self.tokens_by("cluster_id"), "given_clustered")

    @cached_property
    def given_cluster_weights(self) -> DataFrame:
        return tc.topic_term_weights(self.given_clustered, P.max_features)

    @cached_property
    def given_cluster_terms(self) -> DataFrame:
        return materialise(tc.ctfidf_terms(self.given_cluster_weights, P.top_words), "given_cluster_terms")

    @cached_property
    def given_reviews(self) -> DataFrame:
        """The given reviews with labels."""
        labels = self.given_terms.select(
            F.col("topic_id").alias("dominant_topic_id"), F.col("topic_label").alias("dominant_topic_label")
        ).distinct()
        df = self.given.join(labels, "dominant_topic_id", "left")
        df = lb.apply_labels(df, "dominant_topic_id", "dominant_topic_label", P.lda_labels, "dominant_topic_publication_label")
        named = self.given_cluster_terms.filter(F.col("topic_id") != -1)
        df = tc.topic_assign(df, self.given.select("row_ix", "cluster_id"), named)
        label = fl.first_match_label(F.col("bertopic_topic_label"), CLUSTER_RULES)
        return materialise(df.withColumn("bertopic_topic_publication_label", label), "given_reviews", TEXTS)

    @cached_property
    def given_coherence(self) -> DataFrame:
        return materialise(co.coherence_cv(self.tokens, self.given_terms, "LDA", P.coherence_window), "given_coherence")

    @cached_property
    def given_constructs(self) -> DataFrame:
        labels = self.given_terms.select("topic_id", "publication_label").distinct()
        return lb.construct_map_ids(labels, P.lda_constructs)

    @cached_property
    def given_distribution(self) -> DataFrame:
        dist = sm.topic_distribution(self.given_reviews, BRANDS)
        names = lb.label_map_inverse(self.given_terms, P.lda_labels)
        return lb.apply_labels(dist, "dominant_topic_label", "dominant_topic_label", names, "publication_label")

    @cached_property
    def given_summary(self) -> DataFrame:
        return rp.topic_summary(self.given_terms, self.given_coherence, self.given_constructs, "LDA")


CLUSTER_RULES = [("Germanic", ["der", "die"]), ("English", ["that", "with"]), ("Romance", ["que"])]

_STUDIES: dict[tuple[str, str], FixtureStudy] = {}


def study(spark: SparkSession, sf_dir: str) -> FixtureStudy:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        _STUDIES[key] = FixtureStudy(fx.reviews(spark, sf_dir), P)
    return _STUDIES[key]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return fx.reviews(spark, sf_dir)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at ``places`` digits, without a negative zero, so that engines can be compared."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in doubles}) if doubles else df


def on_text(step: Callable[[Column], Column]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw(spark, sf_dir).select("row_ix", step(F.col("reviewer_review")).alias("out"))

    return run


# --- sources and sinks -----------------------------------------------------------------


@query
def src_reviews(spark, sf_dir):
    path = scratch_path(spark, "reviews")
    wr.save_table(raw(spark, sf_dir), path, "parquet")
    return load_reviews(spark, path)


@query
def src_csv_tables(spark, sf_dir):
    """The tables that the publication step reads, written as CSV and read back, in one long form."""
    s = study(spark, sf_dir)
    unlabelled = s.given_cluster_terms.withColumn("publication_label", F.lit(None).cast("string"))
    tables = {
        "topic_coherence": (s.given_coherence, ["model", "topic_id", "topic_label"], "coherence_cv"),
        "construct_mapping": (
            lb.construct_union(s.given_constructs, constructs_by_label(spark, sf_dir)),
            ["model", "topic_id", "publication_label", "primary_construct", "interpretation"], None,
        ),
        "topic_terms": (s.given_terms, ["topic_label", "term", "publication_label"], "weight"),
        "bertopic_terms": (unlabelled, ["topic_label", "term", "publication_label"], "weight"),
        "topic_distribution_by_brand": (s.given_distribution, ["brand", "dominant_topic_label", "publication_label"], "pct_reviews"),
        "aspect_distribution_by_brand": (sm.aspect_prevalence(s.scored, BRANDS), ["brand", "aspect_top_category"], "pct_reviews"),
        "monthly_sentiment_by_brand": (sm.monthly_sentiment(s.scored, BRANDS), ["brand", "review_month"], "mean_compound"),
        "sentiment_summary": (sm.sentiment_summary(s.scored, BRANDS), ["brand", "sentiment_label"], "pct_reviews"),
    }
    folder = scratch_path(spark, "tables")
    save_bundle({name: df for name, (df, _, _) in tables.items()}, folder)
    at, back = open_bundle(spark, folder), None
    for name, (_, keys, number) in tables.items():
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")
        value = (F.col(number) if number else F.lit(0.0)).alias("value")
        rows = load_table(spark, at, name).select(F.lit(name).alias("table_name"), key, value)
        rows = rounded(rows, 12 if number == "mean_compound" else 6)
        back = rows if back is None else back.unionByName(rows)
    return back


@query
def src_params(spark, sf_dir):
    """The dictionary table with the number of reviews that hold each keyword."""
    entries = dictionary_table(spark, P)
    padded = raw(spark, sf_dir).select(kw.padded_lower(F.col("reviewer_review")).alias("t"))
    words = sorted({w for group in (P.aspects, P.emotions) for ws in group.values() for w in ws})
    counts = padded.agg(*[F.count_if(F.col("t").contains(w)).alias(f"n{i}") for i, w in enumerate(words)])
    cells = [F.struct(F.lit(w).alias("keyword"), F.col(f"n{i}").alias("n_reviews")) for i, w in enumerate(words)]
    return entries.join(counts.select(F.inline(F.array(*cells))), "keyword")


@query
def sink_table(spark, sf_dir):
    folder = scratch_path(spark, "tables")
    name = "aspect_distribution_by_brand"
    wr.save_table(sm.aspect_prevalence(study(spark, sf_dir).scored, BRANDS), f"{folder}/{name}")
    return rounded(load_table(spark, folder, name))


def cells(name: str, df: DataFrame, text: list[str], numbers: list[str]) -> DataFrame:
    """Every value of a table in long form: table_name, row_key, column_name, text_value, number_value."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in text])
    none = F.lit(None)
    rows = [(c, F.col(c).cast("string"), none.cast("double")) for c in text] + [(c, none.cast("string"), F.col(c).cast("double")) for c in numbers]
    rows = [F.struct(F.lit(c).alias("column_name"), t.alias("text_value"), n.alias("number_value")) for c, t, n in rows]
    return df.select(F.lit(name).alias("table_name"), key.alias("row_key"), F.inline(F.array(*rows)))


@query
def sink_bundle(spark, sf_dir):
    """The deterministic tables of a study, written as one bundle and read back, every value in long form."""
    tables = {name: QUERIES[source](spark, sf_dir) for name, (source, _, _) in fx.BUNDLE_TABLES.items()}
    folder = scratch_path(spark, "bundle")
    save_bundle(tables, folder)
    at = open_bundle(spark, folder)
    back = [cells(name, load_table(spark, at, name, df.schema), *fx.BUNDLE_TABLES[name][1:]) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, back)


@query
def sink_public(spark, sf_dir):
    return rounded(wr.public_reviews(study(spark, sf_dir).given_reviews))


@query
def sink_compressed(spark, sf_dir):
    public = wr.public_reviews(study(spark, sf_dir).given_reviews)
    folder = scratch_path(spark, "public")
    wr.save_compressed(public, f"{folder}/public")
    return rounded(load_table(spark, folder, "public", public.schema))


@query
def export_scored(spark, sf_dir):
    return rounded(wr.export_scored(study(spark, sf_dir).given_reviews))


@query
def export_dist_renames(spark, sf_dir):
    s = study(spark, sf_dir)
    topics = wr.export_topic_distribution(s.given_distribution).withColumnRenamed("lda_topic_label", "label")
    aspects = wr.export_aspect_distribution(sm.aspect_prevalence(s.scored, BRANDS)).withColumnRenamed("aspect_label", "label")
    return rounded(topics.unionByName(aspects))


# --- projections, cleaning, filters ----------------------------------------------------

QUERIES["clean_newlines"] = on_text(tx.clean_newlines)
QUERIES["clean_mojibake"] = on_text(tx.clean_mojibake)
QUERIES["clean_whitespace"] = on_text(tx.clean_whitespace)
QUERIES["redact_email"] = on_text(tx.redact_email)
QUERIES["redact_phone"] = on_text(lambda t: tx.redact_phone(tx.redact_email(t)))


@query
def std_brand(spark, sf_dir):
    return raw(spark, sf_dir).select("row_ix", tx.std_brand(F.col("name"), P.brand_synonyms).alias("brand"))


def standardised(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return pr.standardise(raw(spark, sf_dir), P).select("row_ix", *columns)


@query
def compose_full_text(spark, sf_dir):
    return standardised(spark, sf_dir, "review_title", "review_text", "review_full_text")


@query
def parse_rating(spark, sf_dir):
    return raw(spark, sf_dir).select("row_ix", tx.parse_rating(F.col("reviewer_rating")).alias("reviewer_rating"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = tx.parse_date(F.col("reviewer_published_date"), P.date_formats)
    return raw(spark, sf_dir).select("row_ix", when.alias("review_date"))


@query
def parse_date(spark, sf_dir):
    return dated(spark, sf_dir).select("row_ix", F.date_format("review_date", "yyyy-MM-dd HH:mm:ss").alias("review_date"))


@query
def derive_month(spark, sf_dir):
    return dated(spark, sf_dir).select("row_ix", tx.derive_month(F.col("review_date")).alias("review_month"))


@query
def token_count(spark, sf_dir):
    return standardised(spark, sf_dir, "token_count")


@query
def filter_sample(spark, sf_dir):
    kept = pr.filter_sample(pr.standardise(raw(spark, sf_dir), P), P)
    return kept.select("row_ix", "reviewer_rating", "token_count", "review_full_text")


@query
def drop_contact_cols(spark, sf_dir):
    return pr.drop_contact_columns(raw(spark, sf_dir))


@query
def brand_domain(spark, sf_dir):
    branded = raw(spark, sf_dir).select("row_ix", tx.std_brand(F.col("name"), P.brand_synonyms).alias("brand"))
    return pr.brand_domain(branded, BRANDS)


@query
def sentiment_label(spark, sf_dir):
    return study(spark, sf_dir).scored.select("row_ix", "compound", "sentiment_label")


@query
def quote_excerpt(spark, sf_dir):
    df = study(spark, sf_dir).sample.filter(F.length("review_full_text") >= rp.QUOTE_MIN_LENGTH)
    return df.select("row_ix", tx.quote_excerpt(F.col("review_full_text"), rp.QUOTE_LENGTH).alias("quote_excerpt"))


@query
def round_summary(spark, sf_dir):
    df = study(spark, sf_dir).scored.select(
        "row_ix",
        F.col("reviewer_rating").alias("mean_rating"),
        (F.col("token_count") / 16.0).alias("mean_sentiment"),
    )
    return sm.round_columns(df, ["mean_rating", "mean_sentiment"])


@query
def first_match_label(spark, sf_dir):
    text = F.lower(F.coalesce(F.col("reviewer_review"), F.lit("")))
    label = fl.first_match_label(F.col("reviewer_review"), P.label_rules)
    raw_label = F.when(label == F.col("reviewer_review"), F.lit("raw")).otherwise(label)
    return raw(spark, sf_dir).select("row_ix", F.length(text).cast("long").alias("n"), raw_label.alias("label"))


# --- tokens ----------------------------------------------------------------------------


def as_text(column: Column | str) -> Column:
    return F.array_join(column, " ")


@query
def tokenize_alpha(spark, sf_dir):
    return raw(spark, sf_dir).select("row_ix", as_text(tk.tokenize_alpha(F.col("reviewer_review"))).alias("tokens"))


@query
def stopword_filter(spark, sf_dir):
    kept = tk.stopword_filter(tk.tokenize_alpha(F.col("reviewer_review")), english_stopwords(P))
    return raw(spark, sf_dir).select("row_ix", as_text(kept).alias("tokens"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw_tokens = tk.raw_tokens(study(spark, sf_dir).sample, english_stopwords(P))
    return tk.token_normalize(raw_tokens.select(F.explode("raw").alias("token")).distinct(), P.stem_map)


@query
def token_normalize(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("token", "stem", "term")


@query
def post_stopwords(spark, sf_dir):
    dropped = english_stopwords(P) + P.custom_stopwords
    return tk.post_stopwords(vocabulary(spark, sf_dir), dropped).select("token", "term")


@query
def token_array(spark, sf_dir):
    return study(spark, sf_dir).tokens.select("row_ix", as_text("tokens").alias("tokens"))


@query
def doc_term_counts(spark, sf_dir):
    return tk.doc_term_counts(study(spark, sf_dir).tokens, P)


@query
def tfidf(spark, sf_dir):
    return rounded(tk.tfidf(study(spark, sf_dir).tokens, P))


# --- scoring ---------------------------------------------------------------------------


@query
def sentiment_scores(spark, sf_dir):
    return rounded(study(spark, sf_dir).scored.select("row_ix", "neg", "neu", "pos", "compound"))


@query
def keyword_count(spark, sf_dir):
    words = [w for ws in P.aspects.values() for w in ws]
    padded = kw.padded_lower(F.coalesce(F.col("reviewer_review"), F.lit("")))
    return raw(spark, sf_dir).select("row_ix", padded.alias("t")).select(
        "row_ix", kw.keyword_count(F.col("t"), words).alias("hits")
    )


@query
def dict_scores(spark, sf_dir):
    df = dc.dict_scores(study(spark, sf_dir).sample, P.aspects, "aspect")
    df = dc.dict_scores(df, P.emotions, "emotion")
    return df.select("row_ix", *[f"aspect_{c}" for c in P.aspects], *[f"emotion_{c}" for c in P.emotions])


@query
def dict_top_category(spark, sf_dir):
    return study(spark, sf_dir).scored.select("row_ix", "aspect_top_category", "emotion_top_category")


# --- topic models ----------------------------------------------------------------------


class Planted:
    """Documents of three word groups, told apart by their first letter, and the topics found in them."""

    def __init__(self, spark, sf_dir):
        configure(spark)
        letter = "substring('abc', cast(doc_id % 3 + 1 as int), 1)"
        words = f"transform(sequence(0, 3 + n_chars % 5), j -> concat({letter}, cast((doc_id * 7 + j * j) % 10 as string)))"
        self.terms = [f"{g}{i}" for g in "abc" for i in range(10)]
        tokens = fx.table(spark, sf_dir, "documents").selectExpr("doc_id as row_ix", f"{words} as tokens")
        self.counts = materialise(tl.count_vectors(tokens, self.terms), "planted_counts")
        self.params = P.with_(lda_topics=3, lda_iterations=30)
        self.model = tl.lda_fit(self.counts, self.params)
        self.topic_terms = materialise(tl.lda_topic_terms(spark, self.model, self.terms, len(self.terms)), "planted_terms")
        top = self.topic_terms.filter("rank = 1")
        self.groups = top.select("topic_id", "topic_label", F.substring("term", 1, 1).alias("word_group"))
        self.prior = 1 / self.params.lda_topics


@query
def lda_fit(spark, sf_dir):
    """The topic-term matrix of planted topics, less its prior: the words of each group, as often as they occur."""
    planted = Planted(spark, sf_dir)
    found = planted.topic_terms.join(planted.groups, "topic_id")
    n = F.round(F.col("weight") - planted.prior).cast("long")
    return found.select("word_group", "term", n.alias("n")).filter("n > 0")


@query
def lda_topic_terms(spark, sf_dir):
    """The heaviest terms of planted topics: counts fall with the rank, and the first three make the label."""
    planted = Planted(spark, sf_dir)
    top = tl.lda_topic_terms(spark, planted.model, planted.terms, 8)
    first = F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), 1, 3), " | ")
    labels = top.groupBy("topic_id").agg((first == F.first("topic_label")).alias("label_is_first_three"))
    found = top.drop("topic_label").join(planted.groups.drop("topic_label"), "topic_id").join(labels, "topic_id")
    n = F.round(F.col("weight") - planted.prior).cast("long")
    return found.select("word_group", "rank", n.alias("n"), "label_is_first_three", (F.substring("term", 1, 1) == F.col("word_group")).alias("of_the_group"))


@query
def lda_doc_topics(spark, sf_dir):
    """The heaviest topic of each document, by the words of that topic, and its share."""
    planted = Planted(spark, sf_dir)
    weights = tl.dominant_topic(tl.lda_weights(planted.counts, planted.model), planted.topic_terms)
    found = weights.join(planted.groups.withColumnRenamed("topic_id", "dominant_topic_id").drop("topic_label"), "dominant_topic_id")
    return found.select("row_ix", "word_group", F.round(F.array_max("topic_weights"), 3).alias("share"))


@query
def embed_svd(spark, sf_dir):
    """Rows of rank three in twelve dimensions, reduced to three axes, which keep all products: each row's with
    itself, and with the sum of all rows."""
    configure(spark)
    word = "concat(substring('abc', cast(doc_id % 3 + 1 as int), 1), cast(j % 4 as string))"
    planted = fx.table(spark, sf_dir, "documents").selectExpr("doc_id as row_ix", f"transform(sequence(0, 4 * (n_chars % 3 + 1) - 1), j -> {word}) as tokens")
    counts = tl.count_vectors(planted, [f"{g}{i}" for g in "abc" for i in range(4)])
    rows, _ = tc.embed_svd(materialise(counts.withColumnRenamed("counts", "tfidf"), "planted_rows"), 3)
    return rounded(products(materialise(rows, "three_axes"), F.size("vec").cast("long").alias("n_axes")))


def products(rows: DataFrame, *more: Column) -> DataFrame:
    """``row_ix, with_all, with_itself``: inner products of each vector with the sum of all, and with itself."""
    by_axis = rows.select(F.posexplode("vec").alias("axis", "x")).groupBy("axis").agg(F.sum("x").alias("x"))
    # one number per axis, at most max_features
    whole = by_axis.agg(F.transform(F.sort_array(F.collect_list(F.struct("axis", "x"))), lambda a: a["x"])).scalar()

    def product(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    vec = F.col("vec")
    return rows.withColumn("whole", whole).select("row_ix", *more, product(vec, F.col("whole")).alias("with_all"), product(vec, vec).alias("with_itself"))


# What must hold for models whose numbers SQL cannot compute, for every review and topic.


@query
def lda_doc_topics_hold(spark, sf_dir):
    """Every review has weights that sum to 1, and the id of its heaviest topic."""
    w, best = F.col("topic_weights"), F.col("dominant_topic_id").cast("int")
    total = F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
    return rounded(
        study(spark, sf_dir).topic_weights.select(
            "row_ix",
            F.size(w).cast("long").alias("n_topics"),
            total.alias("total"),
            (F.get(w, best) == F.array_max(w)).alias("dominant_is_heaviest"),
        )
    )


@query
def lda_topic_terms_hold(spark, sf_dir):
    """Every topic has its top terms at ranks 1 to n, in order of weight, labelled by the first three."""
    by_rank = F.sort_array(F.collect_list(F.struct("rank", "weight", "term")))
    lists = study(spark, sf_dir).topic_terms.groupBy("topic_id", "topic_label").agg(by_rank.alias("t"))
    ranks, weights = F.transform("t", lambda x: x["rank"]), F.transform("t", lambda x: x["weight"])
    first = F.array_join(F.slice(F.transform("t", lambda x: x["term"]), 1, 3), " | ")
    return lists.select(
        "topic_id",
        F.array_join(ranks, ",").alias("ranks"),
        (F.reverse(F.sort_array(weights)) == weights).alias("weights_fall"),
        (first == F.col("topic_label")).alias("label_is_first_three"),
    )


@query
def embed_svd_products(spark, sf_dir):
    """With every axis kept, inner products are those of the TF-IDF rows: each row's product with
    the sum of all rows, and with itself."""
    s = study(spark, sf_dir)
    rows, _ = tc.embed_svd(tc.tfidf_vectors(s.counts, [df for _, df in s.features]), P.max_features)
    return rounded(products(materialise(rows, "all_axes")))


@query
def density_clusters(spark, sf_dir):
    """On vectors with planted clusters: 0.3 * unit embedding, plus 1 in the label's dimension,
    except every tenth row, which stays as it is."""
    configure(spark)
    table = fx.table(spark, sf_dir, "embeddings")
    e = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(F.col("e"), F.lit(0.0), lambda acc, x: acc + x * x))
    planted = F.transform(
        "e", lambda x, i: 0.3 * x / F.col("len") + F.when(i == F.col("label"), 1.0).otherwise(0.0)
    )
    vec = F.when(F.col("vec_id") % 10 == 0, F.col("e")).otherwise(planted)
    vectors = table.withColumn("e", e).withColumn("len", length).select(F.col("vec_id").alias("row_ix"), vec.alias("vec"))
    return tc.density_clusters(vectors, eps=0.6, min_pts=5, min_size=10)


@query
def hierarchical_clusters(spark, sf_dir):
    """On vectors with planted pairs of clusters, each of another density: 0.05 to 0.23 * unit embedding, plus 1 in the
    dimension of the pair and 0.5 in that of the cluster, except every tenth row, which stays as it is."""
    configure(spark)
    table = fx.table(spark, sf_dir, "embeddings")
    e = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(F.col("e"), F.lit(0.0), lambda acc, x: acc + x * x))

    def planted(x, i):
        pair = F.when(i == F.floor(F.col("label") / 2), 1.0).otherwise(0.0)
        return (0.05 + 0.02 * F.col("label")) * x / F.col("len") + pair + F.when(i == 10 + F.col("label") % 2, 0.5).otherwise(0.0)

    vec = F.when(F.col("vec_id") % 10 == 0, F.col("e")).otherwise(F.transform("e", planted))
    vectors = table.withColumn("e", e).withColumn("len", length).select(F.col("vec_id").alias("row_ix"), vec.alias("vec"))
    return tc.hierarchical_clusters(vectors, min_pts=5, min_size=10)


@query
def ctfidf_terms(spark, sf_dir):
    return rounded(study(spark, sf_dir).given_terms.select("topic_id", "topic_label", "rank", "term", "weight"))


@query
def topic_info(spark, sf_dir):
    s = study(spark, sf_dir)
    info = tc.topic_info(s.sample, s.given_clustered, s.given_cluster_weights, s.given_cluster_terms)
    return info.select(
        "bertopic_topic_id", "n_reviews", "Name",
        F.array_join("Representation", ", ").alias("Representation"),
        F.array_join("Representative_Docs", " || ").alias("Representative_Docs"),
    )


@query
def topic_assign(spark, sf_dir):
    return study(spark, sf_dir).given_reviews.select("row_ix", "bertopic_topic_id", "bertopic_topic_label")


# --- coherence -------------------------------------------------------------------------


@query
def topic_word_lists(spark, sf_dir):
    lists = co.topic_word_lists(study(spark, sf_dir).given_terms)
    return lists.select("topic_id", F.array_join("terms", " ").alias("terms"))


@query
def coherence_cv(spark, sf_dir):
    return rounded(study(spark, sf_dir).given_coherence)


@query
def coherence_compare(spark, sf_dir):
    s = study(spark, sf_dir)
    return rounded(co.coherence_compare(s.given_terms, s.given_clustered, s.given_cluster_terms, P.coherence_window))


# --- labels and constructs -------------------------------------------------------------


@query
def apply_labels(spark, sf_dir):
    """Labels for ids 0, 1 and 2; the other topic keeps its raw label."""
    known = {i: label for i, label in P.lda_labels.items() if i < 3}
    df = study(spark, sf_dir).given_reviews
    out = lb.apply_labels(df, "dominant_topic_id", "dominant_topic_label", known, "label")
    return out.select("row_ix", "dominant_topic_id", "label")


@query
def label_map_inverse(spark, sf_dir):
    return lb.label_map_inverse(study(spark, sf_dir).given_terms, P.lda_labels)


@query
def construct_map_ids(spark, sf_dir):
    return study(spark, sf_dir).given_constructs


LANGUAGE_CONSTRUCTS = {"Germanic": ("Low Service Quality", "Words of one family."), "English": ("Brand Hate", "Another.")}


def constructs_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = study(spark, sf_dir).given_reviews.withColumnRenamed("bertopic_topic_publication_label", "publication_label")
    return lb.construct_map_labels(labelled, LANGUAGE_CONSTRUCTS)


@query
def construct_map_labels(spark, sf_dir):
    return constructs_by_label(spark, sf_dir)


@query
def construct_union(spark, sf_dir):
    return lb.construct_union(study(spark, sf_dir).given_constructs, constructs_by_label(spark, sf_dir))


# --- aggregations ----------------------------------------------------------------------


@query
def rating_counts(spark, sf_dir):
    return sm.rating_counts(study(spark, sf_dir).scored, BRANDS)


@query
def brand_summary(spark, sf_dir):
    return rounded(sm.brand_summary(study(spark, sf_dir).scored, BRANDS))


@query
def sentiment_summary(spark, sf_dir):
    return rounded(sm.sentiment_summary(study(spark, sf_dir).scored, BRANDS))


@query
def monthly_sentiment(spark, sf_dir):
    # both sides divide exact sums; six digits would leave decimal ties to the engines' rounding
    return rounded(sm.monthly_sentiment(study(spark, sf_dir).scored, BRANDS), 12)


@query
def topic_distribution(spark, sf_dir):
    return rounded(study(spark, sf_dir).given_distribution)


@query
def cluster_distribution(spark, sf_dir):
    return rounded(sm.cluster_distribution(study(spark, sf_dir).given_reviews, BRANDS))


@query
def aspect_prevalence(spark, sf_dir):
    return rounded(sm.aspect_prevalence(study(spark, sf_dir).scored, BRANDS))


@query
def emotion_prevalence(spark, sf_dir):
    return rounded(sm.emotion_prevalence(study(spark, sf_dir).scored, EMOTIONS, BRANDS))


@query
def top_terms(spark, sf_dir):
    return sm.top_terms(study(spark, sf_dir).tokens, BRANDS)


@query
def zero_fill(spark, sf_dir):
    """Brand x country x emotion grid."""
    return sm.counts_of(study(spark, sf_dir).scored, ["reviewer_country", "emotion_top_category"], BRANDS)


@query
def pct_of_group(spark, sf_dir):
    counts = sm.counts_of(study(spark, sf_dir).scored, ["reviewer_country"], BRANDS)
    return rounded(sm.pct_of_group(counts, "reviewer_country"))


@query
def brand_summary_export(spark, sf_dir):
    return sm.brand_summary_export(study(spark, sf_dir).scored)


@query
def overall_top_aspects(spark, sf_dir):
    return rp.overall_top_aspects(sm.aspect_prevalence(study(spark, sf_dir).scored, BRANDS))


@query
def topic_distinct_labels(spark, sf_dir):
    return lb.topic_distinct_labels(study(spark, sf_dir).given_terms)


# --- windows, sorts, top-k, dedupe -----------------------------------------------------


@query
def dedupe_keep_first(spark, sf_dir):
    """Over all derived reviews, by the raw columns."""
    keys = ["name", "reviewer_name", "reviewer_review"]
    return pr.dedupe_keep_first(raw(spark, sf_dir), keys).select("row_ix", *keys)


@query
def sort_reviews(spark, sf_dir):
    return pr.sort_reviews(study(spark, sf_dir).sample).select("row_ix", "brand", "brand_ord", "url")


@query
def sort_dist(spark, sf_dir):
    shares = sm.pct_of_group(sm.counts_of(study(spark, sf_dir).scored, ["emotion_top_category"], BRANDS))
    return rounded(sm.sort_dist(shares, "emotion_top_category"))


@query
def topk_terms_per_topic(spark, sf_dir):
    """Most frequent terms of each language's reviews."""
    counts = study(spark, sf_dir).given_weights.select("topic_id", "term", F.col("f").alias("weight"))
    return tl.topk_terms_per_topic(counts, 15)


@query
def topk_brands_per_topic(spark, sf_dir):
    return rp.topk_brands_per_topic(study(spark, sf_dir).given_distribution, BRANDS)


@query
def topk_aspects_per_brand(spark, sf_dir):
    return rp.topk_aspects_per_brand(sm.aspect_prevalence(study(spark, sf_dir).scored, BRANDS))


@query
def topic_summary(spark, sf_dir):
    return rounded(study(spark, sf_dir).given_summary)


@query
def representative_quotes(spark, sf_dir):
    s = study(spark, sf_dir)
    order = ["brand_ord", "review_date", "url"]
    return rounded(rp.representative_quotes(s.given, s.given_summary, order=order))


@query
def manuscript_table(spark, sf_dir):
    s = study(spark, sf_dir)
    aspects = sm.aspect_prevalence(s.scored, BRANDS)
    return rounded(rp.manuscript_table(s.given_summary, s.given_distribution, aspects, BRANDS))


@query
def publication_tables(spark, sf_dir):
    """The publication step from the written tables of a study, read back, every value of five tables in long form."""
    s = study(spark, sf_dir)
    aspects = sm.aspect_prevalence(s.scored, BRANDS)
    tables = {
        "topic_coherence": s.given_coherence,
        "construct_mapping": lb.construct_union(s.given_constructs, constructs_by_label(spark, sf_dir)),
        "topic_terms": s.given_terms,
        "bertopic_terms": s.given_cluster_terms.withColumn("publication_label", F.lit(None).cast("string")),
        "topic_distribution_by_brand": s.given_distribution,
        "aspect_distribution_by_brand": aspects,
    }
    folder, out = scratch_path(spark, "tables"), scratch_path(spark, "publication")
    save_bundle(tables, folder)
    scored = s.given_reviews.withColumn("topic_weights", F.array_repeat("membership", P.lda_topics))
    export_publication(spark, folder, out, P, scored)
    study_at = open_bundle(spark, folder, [])
    made = pb.publication_tables(scored, {name: load_table(spark, study_at, name) for name in pb.READS}, P)  # for their schemas
    at, back = open_bundle(spark, out), []
    for name, (_, text, numbers) in fx.PUBLICATION_TABLES.items():
        back.append(cells(name, rounded(load_table(spark, at, name, made[name].schema)), text, numbers))
    return reduce(DataFrame.unionByName, back)


@query
def heatmap_terms(spark, sf_dir):
    labels = [P.lda_labels[i] for i in range(4)]
    wide = ch.heatmap_terms(study(spark, sf_dir).given_terms, labels)
    return wide.toDF("term", "t0", "t1", "t2", "t3")


# --- set operations and chart data -----------------------------------------------------


@query
def union_all(spark, sf_dir):
    s = study(spark, sf_dir)
    return rounded(s.given_terms.drop("publication_label").unionByName(s.given_cluster_terms))


@query
def sentiment_pivot(spark, sf_dir):
    df = study(spark, sf_dir).scored
    return rounded(ch.sentiment_pivot(sm.sentiment_summary(df, BRANDS), sm.brand_summary(df, BRANDS)))


@query
def rating_corr(spark, sf_dir):
    return rounded(ch.rating_corr(study(spark, sf_dir).scored))


@query
def rating_regression(spark, sf_dir):
    return rounded(ch.rating_regression(study(spark, sf_dir).scored))


@query
def rating_regression_band(spark, sf_dir):
    """The band that is drawn around each brand's line."""
    return rounded(ch.regression_band(study(spark, sf_dir).scored))


@query
def topic_dist_totals(spark, sf_dir):
    return rounded(ch.topic_dist_totals(study(spark, sf_dir).given_distribution))


@query
def coherence_plot_rows(spark, sf_dir):
    return rounded(co.coherence_plot_rows(study(spark, sf_dir).given_coherence))


# --- the whole study -------------------------------------------------------------------


@query
def sample_reviews(spark, sf_dir):
    """Preparation end to end."""
    return study(spark, sf_dir).sample.select(
        "row_ix", "brand", "brand_ord", "reviewer_rating", "review_month", "token_count", "review_full_text"
    )


@query
def study_tables(spark, sf_dir):
    """Every table of a study, written and counted."""
    tables = study(spark, sf_dir).tables()
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts
