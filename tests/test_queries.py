"""Every registered query against its SQL, over the whole tables of the smallest scale."""

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry
from registry.duckdb_sql import ORACLES
from registry.spark_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"study_tables"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_only_models_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_returns_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["brand", "aspect_top_category", "n_reviews", "pct_reviews"] and df.count() > 0
