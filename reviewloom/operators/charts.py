"""The numbers behind the charts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SENTIMENT_LABELS = ["positive", "neutral", "negative"]


def sentiment_pivot(sentiment: DataFrame, brands: DataFrame) -> DataFrame:
    """Brand x label shares, 0 where missing, with mean compound."""
    wide = sentiment.groupBy("brand").pivot("sentiment_label", SENTIMENT_LABELS).agg(F.first("pct_reviews"))
    return brands.select("brand", "mean_compound").join(wide, "brand", "left").na.fill(0.0, SENTIMENT_LABELS)


def rating_corr(df: DataFrame) -> DataFrame:
    """Pearson r of compound and rating by brand."""
    return df.dropna(subset=["brand"]).groupBy("brand").agg(F.corr("compound", "reviewer_rating").alias("r"))


def rating_regression(df: DataFrame) -> DataFrame:
    """Straight line of rating on compound by brand."""
    y, x = F.col("reviewer_rating"), F.col("compound")
    return df.dropna(subset=["brand"]).groupBy("brand").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


#: A prime; hashes of (row, replicate) are below it.
PRIME = 2**31 - 1
#: Hashes from which on a Poisson(1) weight is at least 1, 2, ...
POISSON = [math.floor(PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(10)]
ROWS_AT_ONCE = 4096


def poisson_weights(row: np.ndarray, replicates: int) -> np.ndarray:
    """Rows x replicates: how often a row is drawn in a replicate, a Poisson(1) number from an arithmetic hash of both."""
    a, b = row.astype(np.int64)[:, None] % PRIME * 16807 % PRIME, (np.arange(replicates) + 1) * 69621 % PRIME
    h = (a + b) % PRIME
    h = (h * h + 12345) % PRIME
    h = (h * 48271 + b) % PRIME
    h = (h * h + a) % PRIME
    h = h * 16807 % PRIME
    return np.searchsorted(POISSON, h, "right")


def regression_band(df: DataFrame, replicates: int = 200, points: int = 100, level: float = 0.95) -> DataFrame:
    """``brand, point, x, y, y_low, y_high``: the line of rating on compound on a grid from the brand's least to its
    largest compound, and the band that holds the share ``level`` of the lines of Poisson bootstrap replicates.

    One pass: a row's weights in all replicates come from a hash of its ``row_ix``, and tasks return five sums for each
    brand and replicate.  Rows without brand, rating or compound are left out, as are replicates and brands whose
    compound does not vary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            brand = batch.column("brand").dictionary_encode()
            code, x, y, row = brand.indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("x", "y", "row_ix"))
            for at in range(0, len(row), ROWS_AT_ONCE):
                part = slice(at, at + ROWS_AT_ONCE)
                weights = poisson_weights(row[part], replicates).astype(np.float64)
                terms = np.column_stack([np.ones(len(weights)), x[part], y[part], x[part] ** 2, x[part] * y[part]])
                for c in np.unique(code[part]):
                    mine, name = code[part] == c, brand.dictionary[int(c)].as_py()
                    sums[name] = sums.get(name, 0) + weights[mine].T @ terms[mine]
        for name, table in sums.items():
            columns = [pa.array([name] * replicates), pa.array(np.arange(replicates)), *(pa.array(c) for c in np.ascontiguousarray(table.T))]
            yield pa.RecordBatch.from_arrays(columns, ["brand", "replicate", "w", "wx", "wy", "wxx", "wxy"])

    x, y = F.col("compound").cast("double").alias("x"), F.col("reviewer_rating").cast("double").alias("y")
    rows = df.select("brand", "row_ix", x, y).dropna()
    parts = rows.mapInArrow(run, "brand string, replicate long, w double, wx double, wy double, wxx double, wxy double")
    sums = parts.groupBy("brand", "replicate").agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wy", "wxx", "wxy")])
    spread = F.col("w") * F.col("wxx") - F.col("wx") ** 2
    lines = sums.withColumn("spread", spread).filter("spread > 1e-9 * w * w")
    lines = lines.select("brand", ((F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / F.col("spread")).alias("b"), "w", "wx", "wy")
    lines = lines.select("brand", "b", ((F.col("wy") - F.col("b") * F.col("wx")) / F.col("w")).alias("a"))
    ends = rows.groupBy("brand").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    grid = ends.select("brand", "slope", "intercept", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    grid = grid.withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1))
    edges = [(1 - level) / 2, (1 + level) / 2]
    drawn = grid.join(lines, "brand").groupBy("brand", "point", "x", "slope", "intercept").agg(
        *[F.percentile(F.col("a") + F.col("b") * F.col("x"), edge).alias(name) for edge, name in zip(edges, ("y_low", "y_high"), strict=True)]
    )
    return drawn.select("brand", "point", "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"), "y_low", "y_high")


def topic_dist_totals(distribution: DataFrame) -> DataFrame:
    """Rows of each brand in ascending share, with the brand's total."""
    whole = F.sum("n_reviews").over(Window.partitionBy("brand"))
    return distribution.withColumn("total_n", whole).orderBy("brand", F.asc("pct_reviews"))


def heatmap_terms(topic_terms: DataFrame, labels: list[str], max_rank: int = 8) -> DataFrame:
    """Term x label matrix of the best rank."""
    top = topic_terms.filter(F.col("rank") <= max_rank)
    return top.groupBy("term").pivot("publication_label", labels).agg(F.min("rank")).orderBy("term")
