"""Helpers on whole DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pin costly columns, so that filters on them read the value.  Otherwise Catalyst pushes such
    a filter below the projections and the whole expression is evaluated again, per use."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))
