import math
import random
import re

import numpy as np
import pyarrow as pa

from reviewloom.functions.sentiment import sentiment_scores, valence_sums

LEX = {"good": 1.9, "bad": -2.5, "Great": 3.1, "very": 0.2}
NEG = ["not", "never"]
BOOST = {"very": 0.293, "really": 0.293, "slightly": -0.293}


def score(text):
    """The published rules, one word at a time."""
    lex = {k.lower(): v for k, v in LEX.items()}
    words = re.findall("[A-Za-z']+", text or "")
    if not words:
        return 0.0, 0.0, 0.0, 0.0
    low = [w.lower() for w in words]
    values = []
    for i, w in enumerate(words):
        v = lex.get(low[i], 0.0)
        if v:
            sign = math.copysign(1, v)
            if w == w.upper() and re.search("[a-z]", text):
                v += sign * 0.733
            for d, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if i >= d and low[i - d] not in lex:
                    v += sign * BOOST.get(low[i - d], 0.0) * damp
            if any(i >= d and low[i - d] in NEG for d in (1, 2, 3)):
                v *= -0.74
        values.append(v)
    if "but" in low:
        at = low.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(values)]
    q = text.count("?")
    e = 0.292 * min(text.count("!"), 4) + (0 if q < 2 else 0.18 * q if q <= 3 else 0.96)
    s = sum(values)
    s += math.copysign(e, s) if s else 0
    p, n = sum(v + 1 for v in values if v > 0), abs(sum(v - 1 for v in values if v < 0))
    z = sum(v == 0 for v in values)
    if p > n:
        p += e
    elif p < n:
        n += e
    total = p + n + z
    return round(n / total, 3), round(z / total, 3), round(p / total, 3), round(s / math.sqrt(s * s + 15), 4)


def test_rules_against_plain_python(spark):
    rng = random.Random(9)
    vocabulary = ["good", "bad", "great", "GREAT", "BAD", "Good", "not", "never", "very", "really", "slightly", "but", "x", "table", "it's", "VERY", "Not"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(14))) + rng.choice(["", "!", "!!!!!", "?", "??", "???", "????", "!?"]) for _ in range(500)]
    texts += [None, "", "...", "GREAT", "BAD BAD GOOD", "not very good", "good not"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = sentiment_scores(df, "t", LEX, NEG, BOOST).orderBy("i").collect()
    for r, text in zip(rows, texts):
        want = score(text)
        got = (r.neg, r.neu, r.pos, r.compound)
        assert all(abs(a - b) < 1.1e-4 + (1e-3 if k < 3 else 0) * 1.01 for k, (a, b) in enumerate(zip(got, want))), (text, got, want)
    exact = sum((r.neg, r.neu, r.pos, r.compound) == score(t) for r, t in zip(rows, texts))
    assert exact >= len(texts) - 3  # decimal ties may round the other way


def test_words_are_not_listed_in_rows(spark):
    df = spark.createDataFrame([("good",)], "t string")
    scored = sentiment_scores(df, "t", LEX, NEG, BOOST)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "ArrowEvalPython" in plan


def test_sums_of_a_part_of_a_batch_are_those_of_plain_python():
    rng = random.Random(5)
    vocabulary = ["good", "BAD", "Great", "not", "very", "really", "but", "x", "it's", "'", "é", "GOODé", "日本", ""]
    texts = ["good", *(rng.choice(["", " ", "1", "é "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(20))) for _ in range(500)), None, ""]
    lexicon = {k.lower(): v for k, v in LEX.items()}
    boosters = {k: v for k, v in BOOST.items() if k not in lexicon}
    listed = sorted({*lexicon, *boosters, *NEG, "but"})
    tables = [np.array([float(t.get(w, 0)) for w in listed]) for t in (lexicon, boosters)]
    batch = pa.array(texts, pa.string())[1:]
    sums = valence_sums(batch, pa.array(listed), *tables, np.isin(listed, NEG), listed.index("but")).to_pylist()
    for text, got in zip(texts[1:], sums, strict=True):  # without marks nothing is added to the sum
        assert got["n"] == len(re.findall("[A-Za-z']+", text or ""))
        assert abs(round(got["s"] / math.sqrt(got["s"] ** 2 + 15), 4) - score(text)[3]) < 1.1e-4


def test_hand_values(spark):
    df = spark.createDataFrame([("good",), ("not good",), ("GOOD but bad day",), ("",)], "t string")
    got = [r.compound for r in sentiment_scores(df, "t", {"good": 1.9, "bad": -2.5}, ["not"], {}).collect()]
    assert got[0] == round(1.9 / math.sqrt(1.9**2 + 15), 4)
    v = 1.9 * -0.74
    assert got[1] == round(v / math.sqrt(v * v + 15), 4)
    v = (1.9 + 0.733) * 0.5 - 2.5 * 1.5
    assert got[2] == round(v / math.sqrt(v * v + 15), 4)
    assert got[3] == 0.0
