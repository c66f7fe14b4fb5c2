"""Token pipeline: text -> normalised token array -> counts and weights.

Stemming and word lists are applied to the distinct vocabulary, not to every token.  Frequent tokens
are looked up inside the array of their row, which stays compact and is partitioned by ``row_ix``; only
rare tokens are exploded, moved and gathered again.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.porter import porter_stem
from reviewloom.functions.text import lookup
from reviewloom.params import Params, english_stopwords
from reviewloom.session import materialise


def tokenize_alpha(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def stopword_filter(tokens: Column, stopwords: list[str]) -> Column:
    """Keep repeats and order; drop listed tokens."""
    return F.filter(tokens, lambda t: ~t.isin(stopwords)) if stopwords else tokens


def long_enough(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.length(t) > 2)


def raw_tokens(df: DataFrame, stopwords: list[str], text_col: str = "review_full_text") -> DataFrame:
    """``row_ix, raw``: tokens that reach normalisation, in text order."""
    raw = long_enough(stopword_filter(tokenize_alpha(F.col(text_col)), stopwords))
    return df.select("row_ix", raw.alias("raw"))


def token_normalize(words: DataFrame, stem_map: dict[str, str]) -> DataFrame:
    """Distinct ``token`` -> ``token, stem, term``; the map is keyed by stems."""
    stemmed = porter_stem(words, "token", "stem")
    return stemmed.withColumn("term", F.coalesce(lookup(F.col("stem"), stem_map), F.col("stem")))


def post_stopwords(vocabulary: DataFrame, stopwords: list[str]) -> DataFrame:
    """Terms that normalisation turned into listed words are dropped."""
    return vocabulary.filter(~F.col("term").isin(stopwords)) if stopwords else vocabulary


def vocabulary_of(raw: DataFrame, params: Params) -> DataFrame:
    """``token, n, term`` for the distinct tokens of ``row_ix, raw``, written to the shared folder;
    ``n`` counts occurrences, and a token whose normal form is dropped has a null term."""
    words = raw.select(F.explode("raw").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    dropped = sorted(set(english_stopwords(params)) | set(params.custom_stopwords))
    term = F.when(~F.col("term").isin(dropped), F.col("term"))
    vocabulary = token_normalize(words, params.stem_map).select("token", "n", term.alias("term"))
    return materialise(vocabulary, "vocabulary")


def _hits(placed: DataFrame) -> DataFrame:
    """``row_ix, hits``: the ``(pos, term)`` of each row."""
    hit = F.when(F.col("term").isNotNull(), F.struct("pos", "term"))
    return placed.groupBy("row_ix").agg(F.collect_list(hit).alias("hits"))


def _terms_of(words: DataFrame):
    """A function of token arrays: each token's term by ``token, term``, null for others.  ``words`` is sent to
    every task, so its rows must be bounded."""
    table = words.toArrow()
    tokens, terms = (pa.array(table.column(c).to_pylist(), pa.string()) for c in ("token", "term"))
    shared = words.sparkSession.sparkContext.broadcast((tokens, terms))

    @F.arrow_udf("array<string>")
    def look_up(rows: pa.Array) -> pa.Array:
        known, named = shared.value
        at = rows.offsets
        values = rows.values.slice(at[0].as_py(), at[-1].as_py() - at[0].as_py())
        found = named.take(pc.index_in(values, known))
        return pa.ListArray.from_arrays(pc.subtract(at, at[0]), found)

    return look_up


def token_array(df: DataFrame, params: Params, text_col: str = "review_full_text") -> DataFrame:
    """``row_ix, tokens``: normalised tokens of every row, in order, with repeats.

    Raw tokens are written once.  The ``frequent_words`` most frequent words, nearly all occurrences, are
    looked up inside the rows, which move once, by row, and stay compact: no row of its own per token is
    sorted or gathered.  Occurrences of the other, rare words, none of them hot, meet the vocabulary in a
    join by token, and their hits then join the others by row; without rare words that side is empty.
    Rows that share a ``row_ix`` become one, their tokens in order of position.
    """
    raw = materialise(raw_tokens(df, english_stopwords(params), text_col), "raw_tokens")
    vocabulary = vocabulary_of(raw, params)
    by_use = vocabulary.orderBy(F.desc("n"), F.asc("token")).select("token", "term")
    frequent = materialise(by_use.limit(params.frequent_words), "frequent_words")
    known = F.broadcast(frequent.select("token"))  # frequent_words rows: a proven bound
    looked_up = raw.select("row_ix", _terms_of(frequent)("raw").alias("terms")).repartition("row_ix")
    here = looked_up.groupBy("row_ix").agg(F.collect_list("terms").alias("texts"))  # one, unless row_ix is repeated
    rare = materialise(vocabulary.select("token", "term").join(frequent, "token", "left_anti"), "rare_words")
    open_ = raw.select("row_ix", F.posexplode("raw").alias("pos", "token"))
    found = _hits(open_.join(known, "token", "left_anti").join(rare, "token")).withColumnRenamed("hits", "more")
    placed = F.transform("texts", lambda t: F.transform(t, lambda term, pos: F.struct(pos.alias("pos"), term.alias("term"))))
    hits = F.filter(F.flatten(placed), lambda h: h["term"].isNotNull())
    merged = F.transform(F.sort_array(F.concat(hits, F.coalesce("more", F.array()))), lambda h: h["term"])
    plain = F.filter(F.get("texts", F.lit(0)), lambda t: t.isNotNull())
    alone = (F.size("texts") == 1) & (F.col("more").isNull() | (F.size("more") == 0))
    return here.join(found, "row_ix", "left").select("row_ix", F.when(alone, plain).otherwise(merged).alias("tokens"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """One row per distinct term of each row: ``term, tf`` beside the other columns of ``docs``.

    A row holds all its tokens, so they are counted inside the row: sorted, equal tokens are
    neighbours, and a run's length is its count.  Nothing is shuffled.
    """
    rest = [c for c in docs.columns if c != "tokens"]
    s, starts = F.col("_s"), F.col("_starts")
    first_of_run = F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i))
    runs = F.transform(
        starts,
        lambda p, j: F.struct(
            F.get(s, p).alias("term"),
            (F.coalesce(F.get(starts, j + 1), F.size(s)) - p).cast("long").alias("tf"),
        ),
    )
    return (
        docs.withColumn("_s", F.sort_array("tokens"))
        .withColumn("_starts", F.filter(first_of_run, lambda p: p.isNotNull()))
        .select(*rest, F.inline(runs))
    )


def feature_terms(tokens: DataFrame, params: Params) -> DataFrame:
    """``term, df, corpus_tf, term_ix`` of the at most ``max_features`` most frequent terms that
    occur in ``min_df`` rows or more and in ``max_df`` of all rows or fewer; indexed in term order."""
    rows = tokens.agg(F.count("*")).scalar()
    stats = (
        term_frequencies(tokens.select("tokens"))
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("corpus_tf"))
        .filter((F.col("df") >= params.min_df) & (F.col("df") <= F.lit(params.max_df) * rows))
    )
    top = stats.orderBy(F.desc("corpus_tf"), F.asc("term")).limit(params.max_features)
    # at most max_features rows from here on
    return top.withColumn("term_ix", (F.row_number().over(Window.orderBy("term")) - 1).cast("long"))


def doc_term_counts(tokens: DataFrame, params: Params, features: DataFrame | None = None) -> DataFrame:
    """Bag of words ``row_ix, term, term_ix, df, tf`` over the feature terms."""
    if features is None:
        features = feature_terms(tokens, params)
    # max_features rows: a proven bound for the broadcast
    joined = term_frequencies(tokens.select("row_ix", "tokens")).join(F.broadcast(features), "term")
    return joined.select("row_ix", "term", "term_ix", "df", "tf")


def tfidf(tokens: DataFrame, params: Params, features: DataFrame | None = None) -> DataFrame:
    """``row_ix, term, term_ix, weight``: tf * (ln((1+n)/(1+df)) + 1), rows scaled to length 1."""
    rows = tokens.agg(F.count("*")).scalar()
    idf = F.log((1 + rows) / (1 + F.col("df"))) + 1
    # partitioned while compact; the length of a row then needs no shuffle of its own
    placed = tokens.select("row_ix", "tokens").repartition("row_ix")
    if features is None:
        features = feature_terms(tokens, params)
    raw = doc_term_counts(placed, params, features).withColumn("_w", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("row_ix")))
    return raw.select("row_ix", "term", "term_ix", (F.col("_w") / norm).alias("weight"))
