"""Label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.text import lookup


def sentiment_label(compound: Column, positive: float, negative: float) -> Column:
    return (
        F.when(compound >= positive, "positive").when(compound <= negative, "negative").otherwise("neutral")
    )


def first_match_label(raw: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the first rule with a needle inside the lower-cased raw label, else the raw label."""
    low = F.lower(raw)
    chain = None
    for label, needles in rules:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | low.contains(needle)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return raw if chain is None else chain.otherwise(raw)


def mapped_label(key: Column, raw: Column, label_map: dict) -> Column:
    """Label of a small constant map, falling back to the raw label."""
    return F.coalesce(lookup(key, label_map), raw)
