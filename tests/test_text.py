import random
import re

import pytest
from pyspark.sql import functions as F

from reviewloom import params as P
from reviewloom.functions import keywords as kw
from reviewloom.functions import labels as fl
from reviewloom.functions import text as tx


def run(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    return [r.out for r in df.select("i", fn(F.col("t")).alias("out")).orderBy("i").collect()]


def test_newlines(spark):
    assert run(spark, tx.clean_newlines, ["a\r\nb\nc", None]) == ["a  b c", ""]


def test_mojibake_keeps_a_decoded_replacement_character(spark):
    assert run(spark, tx.clean_mojibake, ["caf\u00c3\u00a9 \u00ef\u00bf\u00bd end", "\u00c3\u00a9 \u00ff"]) == ["caf\u00e9 \ufffd end", "\u00e9 "]


def test_mojibake_is_lossy_as_specified(spark):
    got = run(spark, tx.clean_mojibake, ["cafÃ©", "château", "didnâ€™t", "plain é", "â", "日本 Ã©", ""])
    assert got == ["café", "chteau", "didnt", "plain é", "â", " é", ""]


def test_whitespace(spark):
    got = run(spark, tx.clean_whitespace, ["a b \x1c c\tx", "  a 　b ", "\n", "a\x85b"])
    assert got == ["a b c x", "a b", "", "a b"]


def test_whitespace_of_every_kind(spark):
    kinds = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert {*kinds} == {*tx.WHITESPACE_NARROW, *tx.WHITESPACE_WIDE, " "}
    texts = [f"a{k}{more}b c" for k in kinds for more in ("", " ", "\t", "\u2003")] + ["a b c", "a  b", " a", "a\u200bb", None]
    assert run(spark, tx.clean_whitespace, texts) == [" ".join(t.split()) if t else t for t in texts]


def test_plain_texts_are_spared_the_costly_patterns(spark):
    df = spark.createDataFrame([("plain words",)], "t string")

    def plan(step):
        return df.select(step(F.col("t")))._jdf.queryExecution().analyzed().toString().lower()

    assert "contains(" in plan(tx.clean_whitespace) and "rlike" not in plan(tx.clean_whitespace)
    assert "rlike" in plan(tx.redact_phone)


def test_redaction_hand_cases(spark):
    got = run(
        spark,
        lambda t: tx.redact_phone(tx.redact_email(t)),
        ["call +44 20 7946 0958 now 5+123456789 x", "me@x.co ... ", "12345678", "a.b-c@d.example and x@y", "(03) 555-0100 1"],
    )
    assert got == [
        "call [REDACTED_PHONE] now 5+[REDACTED_PHONE] x",
        "[REDACTED_EMAIL] ... ",
        "12345678",
        "[REDACTED_EMAIL] and x@y",
        "([REDACTED_PHONE]",
    ]


def random_texts(n=400, seed=3):
    rng = random.Random(seed)
    pieces = ["a", "é", "Ã©", "â€™", "‚", "Ä", "\n", "\r", "\t", " ", "  ", " ", " ", "\x1d", "7", "+", "(", ")", "-", ".",
              "555 0100 22", "x@y.com", "@", "日", "Ü", "\x85", "42", "word", "٣٤"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(n)]


def by_hand(text):
    """The cleaning rules, spelled out with Python's own functions."""
    text = re.sub("[\r\n]", " ", text)
    if set(text) & set("‚ÄÃâ"):
        text = text.encode("latin-1", "ignore").decode("utf-8", "ignore") or text
    text = " ".join(text.split())
    text = re.sub(P.EMAIL_PATTERN, P.EMAIL_MASK, text)
    return " ".join(re.sub(P.PHONE_PATTERN, P.PHONE_MASK, text).split())


def test_cleaning_matches_python_on_random_text(spark):
    from reviewloom.operators.prepare import clean_columns

    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.c for r in clean_columns(df, {"c": "t"}).orderBy("i").collect()]
    assert got == [by_hand(t) for t in texts]


def test_masking_is_idempotent_on_documents(spark):
    from reviewloom.operators.prepare import clean_columns

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    once = clean_columns(docs, {"c": "text"})
    twice = clean_columns(once, {"d": "c"})
    assert once.filter(F.col("c").contains("REDACTED")).count() > 5
    marked = "[" + P.MOJIBAKE_MARKS + "]"
    assert twice.filter((F.col("c") != F.col("d")) & ~F.col("text").rlike(marked)).count() == 0


def test_compose_and_count(spark):
    df = spark.createDataFrame([("Title", "body."), ("", "me@x.co ..."), ("t", ""), ("", "")], "a string, b string")
    full = [r.x for r in df.select(tx.compose_full_text(F.col("a"), F.col("b")).alias("x")).collect()]
    assert full == ["Title. body", "me@x.co", "t", ""]
    assert run(spark, tx.token_count, ["", "a b", "one"]) == [0, 2, 1]


def test_brand_rating_date(spark):
    assert run(spark, lambda t: tx.std_brand(t, P.BRAND_SYNONYMS), [" Zara ", "HM", "Other ", None]) == ["ZARA", "H&M", "Other", None]
    assert run(spark, tx.parse_rating, ["3", " 2.5 ", "n/a", None]) == [3.0, 2.5, None, None]
    assert run(spark, tx.parse_rating, ["1d", "2f", "1e0", "-.5", "3.", "0x1", ""]) == [None, None, 1.0, -0.5, 3.0, None, None]
    cases = {
        "2021-03-04": "2021-03-04 00:00:00", "2021-03-04T05:06:07Z": "2021-03-04 05:06:07", "2021-03-04 05:06:07": "2021-03-04 05:06:07",
        "2021-03-04T05:06:07.123Z": "2021-03-04 05:06:07", "2021-03-04T05:06": "2021-03-04 05:06:00",
        "2021-03-04T05:06:07+02:00": "2021-03-04 03:06:07", "2021/03/04": "2021-03-04 00:00:00", "3/4/2021": "2021-03-04 00:00:00",
        "Mar 4, 2021": "2021-03-04 00:00:00", "March 14, 2021": "2021-03-14 00:00:00", "4 March 2021": "2021-03-04 00:00:00",
        " 2021-03-04 ": "2021-03-04 00:00:00", "20210304": "2021-03-04 00:00:00", "04-Mar-2021": "2021-03-04 00:00:00",
        "2021-03-04T10:11:12+0000": "2021-03-04 10:11:12", "2021-03-04T10:11:12-0130": "2021-03-04 11:41:12", "2021/03/04 10:00": "2021-03-04 10:00:00",
        "unknown": None, "2021-02-30": None, "": None, "05:06": None, "2021": None,
    }
    got = run(spark, lambda t: F.date_format(tx.parse_date(t, P.DATE_FORMATS), "yyyy-MM-dd HH:mm:ss"), [*cases, None])
    assert dict(zip([*cases, None], got)) == cases | {None: None}


@pytest.mark.parametrize(
    ("text", "words", "expected"),
    [("Refunded refund REFUND delayed", ["refund"], 3), ("aaaa", ["aa"], 2), ("chocolate", ["late"], 1),
     ("refunded", ["refund", "refunded"], 2), ("in store", ["store", "in store"], 2), ("Größe größe", ["größe"], 2)],
)
def test_keyword_count(spark, text, words, expected):
    assert run(spark, lambda t: kw.keyword_count(kw.padded_lower(t), words), [text]) == [expected]


def test_top_category(spark):
    df = spark.createDataFrame([(1, 3, 3), (0, 0, 0), (5, 1, 1)], "a long, b long, c long")
    scores = {"first": F.col("a"), "second": F.col("b"), "third": F.col("c")}
    assert [r.x for r in df.select(kw.top_category(scores).alias("x")).collect()] == ["second", "unclassified", "first"]


def test_sentiment_label_edges(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0,), (0.0499,)], "c double")
    got = [r.x for r in df.select(fl.sentiment_label(F.col("c"), 0.05, -0.05).alias("x")).collect()]
    assert got == ["positive", "negative", "neutral", "neutral"]


def test_first_match_label_uses_rule_order(spark):
    got = run(spark, lambda t: fl.first_match_label(t, P.LABEL_RULES),
              ["order | SHIPPING | gift", "gift | card", "quality | queue", "dress | blue", "clothes | x", "didnt receive"])
    assert got == ["Shipping Delays & Online Fulfilment", "Gift Card & Store Credit Issues",
                   "In-Store Staff, Policy & Queue Problems", "dress | blue", "Mixed Negative Complaints", "Non-Delivery & Missing Parcel"]


def test_percent_text_ties_to_even(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (12.34,), (100.0,)], "p double")
    assert [r.x for r in df.select(tx.percent_text(F.col("p")).alias("x")).collect()] == ["0.2%", "0.8%", "12.3%", "100.0%"]


def test_quote_excerpt(spark):
    assert run(spark, lambda t: tx.quote_excerpt(t, 5), ["  ab\ncdef "]) == ["ab cd"]
