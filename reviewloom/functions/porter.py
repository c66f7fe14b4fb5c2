"""Porter's suffix stripper (1980, with the two later amendments of its author, ``bli`` and
``logi``) as DataFrame steps.

Meant for a table of distinct words, where each step is a ``CASE`` over suffixes.  Every step is
its own projection, so no expression is evaluated more than once per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.frames import computed_once

# A run of consonants, a run of vowels, one vowel.  "y" is a vowel after a consonant.
C = "[^aeiou][^aeiouy]*"
V = "[aeiouy][aeiou]*"
v = "[aeiouy]"
MEASURE_OVER_0 = f"^({C})?{V}{C}"
MEASURE_IS_1 = f"^({C})?{V}{C}({V})?$"
MEASURE_OVER_1 = f"^({C})?{V}{C}{V}{C}"
HAS_VOWEL = f"^({C})?{v}"
SHORT = f"^{C}{v}[^aeiouwxy]$"
DOUBLE = r"([^aeiou])\1$"

# The suffix tables of the published algorithm, longest first where one ends in another.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


def _without(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _replace_suffix(word: Column, table: dict[str, str], condition: str) -> Column:
    """The longest suffix that fits decides; it is replaced if its stem meets the condition."""
    chain = None
    for suffix, new in sorted(table.items(), key=lambda kv: -len(kv[0])):
        stem = _without(word, suffix)
        done = F.when(stem.rlike(condition), F.concat(stem, F.lit(new))).otherwise(word)
        test = word.endswith(suffix)
        chain = F.when(test, done) if chain is None else chain.when(test, done)
    return chain.otherwise(word)


def _plurals(w: Column) -> Column:
    return (
        F.when(w.endswith("sses") | w.endswith("ies"), _without(w, "es"))
        .when(w.endswith("ss"), w)
        .when(w.endswith("s"), _without(w, "s"))
        .otherwise(w)
    )


def _past_and_gerund(w: Column) -> tuple[Column, Column]:
    """Stripped word, and whether ``ed`` or ``ing`` came off."""
    eed = F.when(_without(w, "eed").rlike(MEASURE_OVER_0), _without(w, "d")).otherwise(w)
    off_ed = w.endswith("ed") & ~w.endswith("eed") & _without(w, "ed").rlike(HAS_VOWEL)
    off_ing = w.endswith("ing") & _without(w, "ing").rlike(HAS_VOWEL)
    stripped = (
        F.when(w.endswith("eed"), eed).when(off_ed, _without(w, "ed")).when(off_ing, _without(w, "ing")).otherwise(w)
    )
    return stripped, off_ed | off_ing


def _tidy(w: Column) -> Column:
    return (
        F.when(w.endswith("at") | w.endswith("bl") | w.endswith("iz"), F.concat(w, F.lit("e")))
        .when(w.rlike(DOUBLE) & ~w.rlike("[lsz]$"), F.substring(w, F.lit(1), F.length(w) - 1))
        .when(w.rlike(SHORT), F.concat(w, F.lit("e")))
        .otherwise(w)
    )


def _final_e(w: Column) -> Column:
    stem = _without(w, "e")
    drop = stem.rlike(MEASURE_OVER_1) | (stem.rlike(MEASURE_IS_1) & ~stem.rlike(SHORT))
    return F.when(w.endswith("e") & drop, stem).otherwise(w)


def _step_4(w: Column) -> Column:
    rules = {suffix: "" for suffix in STEP_4}
    ion_stem = _without(w, "ion")
    ion = F.when(ion_stem.rlike(MEASURE_OVER_1) & ion_stem.rlike("[st]$"), ion_stem).otherwise(w)
    return F.when(w.endswith("ion"), ion).otherwise(_replace_suffix(w, rules, MEASURE_OVER_1))


def porter_stem(df: DataFrame, word_col: str, out_col: str) -> DataFrame:
    """Add ``out_col``, the stem of the lower-case word in ``word_col``; words of two letters or
    fewer stay as they are."""
    w = F.col("_w")
    stripped, came_off = _past_and_gerund(w)
    stemmed = (
        df.withColumn("_w", _plurals(F.col(word_col)))
        .withColumns({"_off": came_off, "_w": stripped})
        .withColumn("_w", F.when(F.col("_off"), _tidy(w)).otherwise(w))
        .withColumn("_w", F.when(w.endswith("y") & _without(w, "y").rlike(HAS_VOWEL), F.concat(_without(w, "y"), F.lit("i"))).otherwise(w))
        .withColumn("_w", _replace_suffix(w, STEP_2, MEASURE_OVER_0))
        .withColumn("_w", _replace_suffix(w, STEP_3, MEASURE_OVER_0))
        .withColumn("_w", _step_4(w))
        .withColumn("_w", _final_e(w))
        .withColumn("_w", F.when(w.endswith("ll") & w.rlike(MEASURE_OVER_1), _without(w, "l")).otherwise(w))
        .withColumn(out_col, F.when(F.length(word_col) <= 2, F.col(word_col)).otherwise(w))
        .drop("_w", "_off")
    )
    return computed_once(stemmed, [out_col])
