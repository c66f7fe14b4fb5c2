import numpy as np
import datetime

from pyspark.sql import functions as F

from reviewloom.operators import charts as ch
from reviewloom.operators import summaries as sm

BRANDS = ["B", "A", "Empty"]


def scored(spark):
    rows = [
        (1, "A", 1, "positive", 0.9, 1.0, "x", datetime.date(2021, 1, 1), 2, 0),
        (2, "A", 2, "negative", -0.5, 2.0, "x", datetime.date(2021, 1, 1), 1, 1),
        (3, "A", 3, "negative", -0.7, 2.0, "y", datetime.date(2021, 3, 1), 0, 0),
        (4, "A", 10, "neutral", 0.0, 3.0, "y", None, 0, 0),
        (5, "B", 7, "positive", 0.3, 3.0, "x", datetime.date(2021, 1, 1), 0, 1),
        (6, None, 7, "positive", 0.3, 1.0, "only unlisted", datetime.date(2021, 2, 1), 0, 1),
    ]
    return spark.createDataFrame(
        rows,
        "row_ix long, brand string, token_count long, sentiment_label string, compound double, reviewer_rating double,"
        " aspect_top_category string, review_month date, emotion_joy long, emotion_fear long",
    ).withColumn("review_date", F.col("review_month")).repartition(3)


def test_rating_counts_grid(spark):
    rows = [tuple(r) for r in sm.rating_counts(scored(spark), BRANDS).collect()]
    assert rows == [("B", 1.0, 0), ("B", 2.0, 0), ("B", 3.0, 1), ("A", 1.0, 1), ("A", 2.0, 2), ("A", 3.0, 1),
                    ("Empty", 1.0, 0), ("Empty", 2.0, 0), ("Empty", 3.0, 0)]


def test_brand_summary_median_and_empty_brand(spark):
    rows = {r.brand: r for r in sm.brand_summary(scored(spark), BRANDS).collect()}
    assert rows["A"].median_tokens == 2.5 and rows["A"].mean_tokens == 4.0 and abs(rows["A"].mean_compound + 0.075) < 1e-12
    assert rows["Empty"].n_reviews == 0 and rows["Empty"].mean_tokens is None and rows["Empty"].median_tokens is None


def test_shares_zero_fill_values_of_unlisted_brands_and_null_for_empty(spark):
    rows = [tuple(r) for r in sm.aspect_prevalence(scored(spark), BRANDS).collect()]
    assert rows[:3] == [("B", "x", 1, 100.0), ("B", "only unlisted", 0, 0.0), ("B", "y", 0, 0.0)]
    assert rows[3:6] == [("A", "x", 2, 50.0), ("A", "y", 2, 50.0), ("A", "only unlisted", 0, 0.0)]
    assert all(r[2] == 0 and r[3] is None for r in rows[6:]) and len(rows) == 9


def test_monthly_drops_undated_and_fills(spark):
    rows = [tuple(r) for r in sm.monthly_sentiment(scored(spark), BRANDS).collect()]
    assert len(rows) == 9
    assert rows[3] == ("A", datetime.date(2021, 1, 1), 0.2, 2)
    assert rows[4] == ("A", datetime.date(2021, 2, 1), None, 0)


def test_emotions_are_multi_label_and_alphabetical(spark):
    rows = [tuple(r) for r in sm.emotion_prevalence(scored(spark), ["joy", "fear"], BRANDS).collect()]
    assert rows == [("A", "joy", 2, 50.0), ("A", "fear", 1, 25.0), ("B", "fear", 1, 100.0), ("B", "joy", 0, 0.0),
                    ("Empty", "fear", 0, 0.0), ("Empty", "joy", 0, 0.0)]


def test_cluster_distribution_excludes_outliers_first(spark):
    df = spark.createDataFrame([("A", -1, "o"), ("A", 0, "t"), ("A", 1, "u"), ("B", -1, "o")], "brand string, bertopic_topic_id long, bertopic_topic_label string")
    rows = [tuple(r) for r in sm.cluster_distribution(df, ["A", "B"]).collect()]
    assert rows == [("A", "t", 1, 50.0), ("A", "u", 1, 50.0), ("B", "t", 0, None), ("B", "u", 0, None)]


def test_top_terms_first_seen_wins_ties(spark):
    df = spark.createDataFrame(
        [(1, "A", 1, datetime.date(2021, 2, 1), "u"), (2, "A", 1, datetime.date(2021, 1, 1), "u"), (3, "B", 2, None, "u")],
        "row_ix long, brand string, brand_ord int, review_date date, url string",
    )
    tokens = spark.createDataFrame(
        [(1, ["late", "gone", "cat", "cat"]), (2, ["sent", "gone", "late"]), (3, ["zeta", "beta", "beta"])], "row_ix long, tokens array<string>"
    )
    rows = [tuple(r) for r in sm.top_terms(df.join(tokens, "row_ix"), ["A", "B"], 2).collect()]
    # "gone" and "late" tie; "gone" comes first in the earlier review
    assert rows == [("A", 1, "gone", 2), ("A", 2, "late", 2), ("B", 1, "beta", 2), ("B", 2, "zeta", 1)]


def test_brand_summary_export_rounds_half_even(spark):
    rows = {r.brand: r for r in sm.brand_summary_export(scored(spark)).collect()}
    assert list(rows) == ["A", "B"] and rows["A"].mean_rating == 2.0 and rows["A"].pct_neutral == 25.0
    df = spark.createDataFrame([(0.0625, 0.1875)], "a double, b double")
    assert tuple(sm.round_columns(df, ["a", "b"]).first()) == (0.062, 0.188)


def test_exact_mean_does_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, -0.6, 0.7, 0.0001] * 50
    means = set()
    for parts in (1, 5, 16):
        df = spark.createDataFrame([(v,) for v in values], "c double").repartition(parts)
        means.add(df.agg(sm.exact_mean(F.col("c")).alias("m")).first().m)
    assert len(means) == 1


def test_chart_data(spark):
    df = scored(spark)
    wide = {r.brand: r for r in ch.sentiment_pivot(sm.sentiment_summary(df, BRANDS), sm.brand_summary(df, BRANDS)).collect()}
    assert (wide["A"].positive, wide["A"].neutral, wide["A"].negative) == (25.0, 25.0, 50.0)
    assert wide["Empty"].positive == 0.0
    terms = spark.createDataFrame([(0, "a", 1, "L0"), (0, "b", 9, "L0"), (1, "a", 3, "L1"), (2, "a", 2, "L1")], "topic_id long, term string, rank long, publication_label string")
    assert [tuple(r) for r in ch.heatmap_terms(terms, ["L0", "L1"]).collect()] == [("a", 1, 2)]
    line = {r.brand: r for r in ch.rating_regression(df).collect()}["A"]
    import numpy as np

    x, y = np.array([0.9, -0.5, -0.7, 0.0]), np.array([1.0, 2.0, 2.0, 3.0])
    slope, intercept = np.polyfit(x, y, 1)
    assert abs(line.slope - slope) < 1e-9 and abs(line.intercept - intercept) < 1e-9
    r = {r.brand: r.r for r in ch.rating_corr(df).collect()}["A"]
    assert abs(r - np.corrcoef(x, y)[0, 1]) < 1e-9


def test_poisson_weights():
    w = ch.poisson_weights(np.arange(20_000) * 7 + 3, 60)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.003
    together = np.corrcoef(w.T) - np.eye(60)
    assert np.abs(together).max() < 0.04 and np.abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01


def test_regression_band(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, 400).round(3)
    y = (2 + 0.5 * x + rng.normal(size=400)).round(3)
    rows = [("AB"[i % 2], i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("C", 900, 0.5, 1.0), (None, 901, 0.1, 1.0), ("A", 902, None, 1.0)]
    df = spark.createDataFrame(rows, "brand string, row_ix long, compound double, reviewer_rating double")
    got = {(r.brand, r.point): r for r in ch.regression_band(df.repartition(5), 100, 11).collect()}
    assert sorted({b for b, _ in got}) == ["A", "B"] and len(got) == 22  # one value of compound makes no line
    for k, brand in enumerate("AB"):
        a, b, weights = x[k::2], y[k::2], ch.poisson_weights(np.arange(k, 400, 2), 100)
        lines = [np.polyfit(a, b, 1, w=np.sqrt(w)) for w in weights.T]
        for i, at in enumerate(np.linspace(a.min(), a.max(), 11)):
            r = got[brand, i]
            drawn = [m * at + c for m, c in lines]
            np.testing.assert_allclose([r.x, r.y, r.y_low, r.y_high], [at, np.polyval(np.polyfit(a, b, 1), at), *np.quantile(drawn, [0.025, 0.975])], rtol=1e-7)
            assert r.y_low < r.y < r.y_high
