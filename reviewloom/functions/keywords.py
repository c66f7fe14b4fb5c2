"""Dictionary coding: keyword counts and the best category of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_lower(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def keyword_count(padded: Column, keywords: list[str]) -> Column:
    """Non-overlapping substring hits of all ``keywords`` in an already padded, lower-cased text.

    Counted by how many bytes vanish when a keyword is removed; byte lengths cost nothing to read.
    """
    total = F.lit(0)
    for keyword in keywords:
        needle = keyword.lower()
        width = len(needle.encode("utf-8"))
        if not width:
            raise ValueError("empty keyword")
        gone = F.octet_length(padded) - F.octet_length(F.replace(padded, F.lit(needle), F.lit("")))
        total = total + (gone / F.lit(width)).cast("long")
    return total.cast("long")


def top_category(scores: dict[str, Column], default: str = "unclassified") -> Column:
    """Name of the highest score; the first in declared order on a tie; ``default`` if all are 0."""
    values = F.array(*scores.values())
    names = F.array(*[F.lit(name) for name in scores])
    best = F.array_max(values)
    return F.when(best <= 0, F.lit(default)).otherwise(
        F.get(names, (F.array_position(values, best) - 1).cast("int"))
    )
