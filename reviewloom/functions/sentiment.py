"""Lexicon valence scoring after Hutto & Gilbert (2014).

One review is one row throughout: in an Arrow batch of texts all words lie one after the other, and only the words
that matter (lexicon entries, negators, boosters, "but") are kept with their positions; the rules look back over
those.  No explode, no join, no shuffle.  Sums leave Python, and shares are made of them by expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.frames import computed_once

# Constants of the published method.
CAPS_BOOST = 0.733
NEGATION = -0.74
DAMPING = (1.0, 0.95, 0.9)
EXCLAMATION = 0.292
QUESTION = 0.18
QUESTION_MAX = 0.96
NORMALISER = 15.0

MAX_LEXICON = 50_000


SUMS = "n long, scored long, s double, p double, q double"


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text of each word, lower-cased words, whether a word has lower-case letters) of runs of ``[A-Za-z']``, which
    are the same in characters and in UTF-8 bytes.  Letters lie one after the other, so words need no strings."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    folded = data | 0x20
    letter = (folded >= ord("a")) & (folded <= ord("z"))
    inside = letter | (data == ord("'"))
    new_text = np.zeros(len(data) + 1, dtype=bool)
    new_text[bounds - bounds[0]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | new_text[1:-1]
    starts = np.flatnonzero(first)
    owner = np.searchsorted(bounds - bounds[0], starts, "right") - 1
    at = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    low = np.where(letter, folded, data)[inside]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(low))
    small = np.append(0, np.cumsum((letter & (data >= ord("a")))[inside]))
    return owner, words, small[at[1:]] > small[at[:-1]]


def valence_sums(texts: pa.Array, words: pa.Array, value: np.ndarray, boost: np.ndarray, negates: np.ndarray, but: int) -> pa.Array:
    """For each text: its words, the words with a valence, the sum of valences, of those above 0 plus 1 each, and of
    those below 0 less 1 each.  ``words`` matter, with a value, a boost and a negator mark each; ``but`` is its place."""
    rows = len(texts)
    owner, found, lower = _words(texts.fill_null(""))
    n = np.bincount(owner, minlength=rows)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    mixed = np.bincount(owner[lower], minlength=rows) > 0
    which = pc.index_in(found, words).fill_null(-1).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(which >= 0)
    which, pos, row, shouted = which[kept], pos[kept], owner[kept], ~lower[kept] & mixed[owner[kept]]
    base = value[which]
    v = base + np.where(shouted, np.sign(base) * CAPS_BOOST, 0.0)
    sign, total, negated = np.sign(v), v.copy(), np.zeros(len(v), dtype=bool)
    damp = np.array([0.0, *DAMPING])
    for back in (1, 2, 3):  # at most three kept words can lie within three positions
        gap = pos[back:] - pos[:-back]
        near = (row[back:] == row[:-back]) & (gap <= 3)
        total[back:] += np.where(near, sign[back:] * boost[which[:-back]] * damp[np.where(near, gap, 0)], 0.0)
        negated[back:] |= near & negates[which[:-back]]
    total = np.where(negated, total * NEGATION, total)
    first_but = np.full(rows, -1)
    buts = np.flatnonzero(which == but)[::-1]
    first_but[row[buts]] = pos[buts]
    turn = first_but[row]
    total = total * np.where(turn < 0, 1.0, np.where(pos < turn, 0.5, np.where(pos > turn, 1.5, 1.0)))
    scored = (v != 0) & (total != 0)
    row, total = row[scored], total[scored]
    up, down = total > 0, total < 0
    sums = {
        "n": n,
        "scored": np.bincount(row, minlength=rows),
        "s": np.bincount(row, total, rows),  # added up in the order of words
        "p": np.bincount(row[up], total[up] + 1, rows),
        "q": np.abs(np.bincount(row[down], total[down] - 1, rows)),
    }
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64 if k in ("n", "scored") else np.float64)) for k, x in sums.items()], names=list(sums))


def _summed(text: Column, lexicon: dict[str, float], negators: list[str], boosters: dict[str, float]) -> Column:
    listed = sorted(set(lexicon) | set(boosters) | set(negators) | {"but"})
    value, boost = (np.array([float(table.get(w, 0.0)) for w in listed]) for table in (lexicon, boosters))
    negates = np.isin(listed, negators) if negators else np.zeros(len(listed), dtype=bool)
    shared = SparkSession.active().sparkContext.broadcast((listed, value, boost, negates))  # MAX_LEXICON words

    @F.arrow_udf(SUMS)
    def sums(texts: pa.Array) -> pa.Array:
        listed, *tables = shared.value
        return valence_sums(texts, pa.array(listed, pa.string()), *tables, listed.index("but"))

    return sums(text)


def sentiment_scores(
    df: DataFrame,
    text_col: str,
    lexicon: dict[str, float],
    negators: list[str],
    boosters: dict[str, float],
) -> DataFrame:
    """Add ``neg, neu, pos, compound``.

    A word's valence v gets, in order: +-0.733 if it is all upper-case in a text that has
    lower-case letters; the damped boost of each of the three words before it that is a booster
    and not itself in the lexicon, in the direction of v; times -0.74 once if any of those three
    is a negator; times 0.5 before the first "but" and 1.5 after it.
    """
    if len(lexicon) > MAX_LEXICON:
        raise ValueError(f"lexicon has {len(lexicon)} entries, more than {MAX_LEXICON}")
    lexicon = {k.lower(): v for k, v in lexicon.items()}
    plain_boosters = {k.lower(): v for k, v in boosters.items() if k.lower() not in lexicon}
    negators = [w.lower() for w in negators]
    text = F.coalesce(F.col(text_col), F.lit(""))

    def occurrences(mark: str) -> Column:
        return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))

    exclaim = F.least(occurrences("!"), F.lit(4)) * EXCLAMATION
    questions = occurrences("?")
    asked = F.when(questions < 2, 0.0).when(questions <= 3, questions * QUESTION).otherwise(QUESTION_MAX)

    sums = _summed(text, lexicon, negators, plain_boosters)
    scored = df.withColumns({"_sums": sums, "_e": exclaim + asked}).withColumns(
        {
            "_n": F.col("_sums.n"),
            "_s": F.col("_sums.s"),
            "_p": F.col("_sums.p"),
            "_q": F.col("_sums.q"),
            "_z": (F.col("_sums.n") - F.col("_sums.scored")).cast("double"),
        }
    )
    s, e, p, q, z = (F.col(c) for c in ("_s", "_e", "_p", "_q", "_z"))
    scored = scored.withColumns(
        {
            "_s": s + F.signum(s) * e,
            "_p": F.when(p > q, p + e).otherwise(p),
            "_q": F.when(p < q, q + e).otherwise(q),
        }
    )
    whole = p + q + z

    def share(part: Column) -> Column:
        return F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.round(part / whole, 3))

    compound = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.round(s / F.sqrt(s * s + NORMALISER), 4))
    scored = scored.withColumns({"neg": share(q), "neu": share(z), "pos": share(p), "compound": compound})
    scored = scored.drop("_sums", "_e", "_n", "_s", "_p", "_q", "_z")
    return computed_once(scored, ["neg", "neu", "pos", "compound"])
