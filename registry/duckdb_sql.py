"""The same answers in DuckDB SQL, written independently of the Spark code.

``CTES`` are named building blocks; ``statement`` puts the ones a query needs before it.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from registry import fixture as fx
from registry.spark_queries import CLUSTER_RULES, EMOTIONS, LANGUAGE_CONSTRUCTS
from reviewloom.operators import report as rp
from reviewloom.params import EXPORT_COLUMNS, LDA_CONSTRUCTS, MOJIBAKE_MARKS, PUBLIC_COLUMNS

P = fx.PARAMS


# Written out here, and not taken from the code under test: Unicode white space with the separators
# U+001C..U+001F, the constants of the sentiment rules, and Porter's suffix tables (fixed values).
WHITESPACE = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
CAPS_BOOST, NEGATION, EXCLAMATION, QUESTION, QUESTION_MAX = 0.733, -0.74, 0.292, 0.18, 0.96
PORTER_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def case_lookup(expr: str, mapping: dict, otherwise: str = "NULL") -> str:
    def lit(x):
        return q(x) if isinstance(x, str) else str(x)

    return f"CASE {expr} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + f" ELSE {otherwise} END"


def r6(expr: str, name: str | None = None, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name or expr}"


# --- text steps ------------------------------------------------------------------------

DIGIT = r"\p{Nd}"


def newlines(x: str) -> str:
    return rf"translate(coalesce({x}, ''), chr(13) || chr(10), '  ')"


def mojibake(x: str) -> str:
    """Valid UTF-8 byte runs among the Latin-1 characters, decoded; other high bytes dropped."""
    runs = "|".join(
        [
            r"[\x{00}-\x{7F}]+",
            r"[\x{C2}-\x{DF}][\x{80}-\x{BF}]",
            r"\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]",
            r"[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}",
            r"\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]",
            r"\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}",
            r"[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}",
            r"\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2}",
        ]
    )
    latin = rf"regexp_replace({x}, '[^\x{{00}}-\x{{FF}}]', '', 'g')"
    b = [f"(unicode(m[{i}]) & 63)" for i in range(1, 5)]
    decode = (
        "CASE WHEN unicode(m[1]) < 128 THEN m "
        f"WHEN length(m) = 2 THEN chr((((unicode(m[1]) & 31) << 6) | {b[1]})::INT) "
        f"WHEN length(m) = 3 THEN chr((((unicode(m[1]) & 15) << 12) | ({b[1]} << 6) | {b[2]})::INT) "
        f"ELSE chr((((unicode(m[1]) & 7) << 18) | ({b[1]} << 12) | ({b[2]} << 6) | {b[3]})::INT) END"
    )
    repaired = f"array_to_string(list_transform(regexp_extract_all({latin}, '{runs}'), lambda m: {decode}), '')"
    return f"CASE WHEN regexp_matches({x}, '[{MOJIBAKE_MARKS}]') THEN coalesce(nullif({repaired}, ''), {x}) ELSE {x} END"


def whitespace(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WHITESPACE}', ' ', 'g'))"


def email(x: str) -> str:
    return rf"regexp_replace({x}, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b', '[REDACTED_EMAIL]', 'g')"


def phone(x: str) -> str:
    body = rf"\+?{DIGIT}[{DIGIT}\s().-]{{7,}}{DIGIT}"
    return f"regexp_replace({x}, '{body}', '[REDACTED_PHONE]', 'g')"


def staged(columns: dict[str, str], source: str) -> dict[str, str]:
    """One CTE per cleaning step."""
    steps = [newlines, mojibake, whitespace, email, phone, whitespace]
    out, previous = {}, source
    for i, step in enumerate(steps):
        if i == 0:
            cells = ", ".join(f"{step(src)} AS {name}" for name, src in columns.items())
            out[f"clean_{i}"] = f"SELECT *, {cells} FROM {previous}"
        else:
            cells = ", ".join(f"{step(name)} AS {name}" for name in columns)
            out[f"clean_{i}"] = f"SELECT * REPLACE ({cells}) FROM {previous}"
        previous = f"clean_{i}"
    return out


def words_of(x: str) -> str:
    return f"CASE WHEN {whitespace(x)} = '' THEN 0 ELSE len(string_split({whitespace(x)}, ' ')) END::BIGINT"


BRAND = case_lookup("trim(name)", P.brand_synonyms, "trim(name)")
BRAND_ORD = case_lookup("brand", {b: i + 1 for i, b in enumerate(P.brand_order)})
BRANDS = values([(b, i + 1) for i, b in enumerate(P.brand_order)], "brand, brand_ord")


def keyword_hits(text: str, keywords) -> str:
    padded = f"(' ' || lower({text}) || ' ')"
    return " + ".join(f"((length({padded}) - length(replace({padded}, {q(k)}, ''))) // {len(k)})" for k in keywords)


def top_category(prefix: str, categories) -> str:
    cols = [f"{prefix}_{c}" for c in categories]
    best = f"greatest({', '.join(cols)})"
    tests = " ".join(f"WHEN {c} = {best} THEN {q(name)}" for c, name in zip(cols, categories))
    return f"CASE WHEN {best} <= 0 THEN 'unclassified' {tests} END AS {prefix}_top_category"


def rules_case(expr: str, rules, otherwise: str) -> str:
    tests = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({expr}), {q(n)})' for n in needles)} THEN {q(label)}" for label, needles in rules
    )
    return f"CASE {tests} ELSE {otherwise} END"


def share_table(label: str, source: str, where: str = "TRUE") -> str:
    """Zero-filled grid with shares, from scratch: distinct values x brands, left join counts."""
    return f"""
      SELECT g.brand, g.brand_ord, g.{label}, coalesce(c.n, 0)::BIGINT AS n_reviews,
             100.0 * coalesce(c.n, 0) / nullif(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.brand), 0) AS pct_reviews
      FROM (SELECT b.brand, b.brand_ord, v.{label} FROM brands b
            CROSS JOIN (SELECT DISTINCT {label} FROM {source} WHERE {label} IS NOT NULL AND {where}) v) g
      LEFT JOIN (SELECT brand, {label}, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL) c
        ON c.brand = g.brand AND c.{label} = g.{label}"""


# --- Porter ----------------------------------------------------------------------------


def suffix_case(table: dict[str, str], condition: str) -> str:
    tests = []
    for suffix, new in sorted(table.items(), key=lambda kv: -len(kv[0])):
        stem = f"left(w, length(w) - {len(suffix)})"
        tests.append(
            f"WHEN ends_with(w, {q(suffix)}) THEN CASE WHEN regexp_matches({stem}, '{condition}') THEN {stem} || {q(new)} ELSE w END"
        )
    return "CASE " + " ".join(tests) + " ELSE w END"


def cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"  # a run of consonants, a run of vowels
M0, M1, MM, VOW, CVC = (
    f"^({C})?{V}{C}", f"^({C})?{V}{C}({V})?$", f"^({C})?{V}{C}{V}{C}", f"^({C})?[aeiouy]", f"^{C}[aeiouy][^aeiouwxy]$",
)


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


PORTER = {
    "p0": "SELECT DISTINCT tok AS token, tok AS w FROM raw_token",
    "p1a": f"""SELECT token, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)}
               WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END AS w FROM p0""",
    "p1b": f"""SELECT token, w, CASE
               WHEN ends_with(w, 'eed') THEN 0
               WHEN ends_with(w, 'ed') AND {has(cut(2), VOW)} THEN 2
               WHEN ends_with(w, 'ing') AND {has(cut(3), VOW)} THEN 3 ELSE 0 END AS off FROM p1a""",
    "p1c": f"""SELECT token, off, CASE WHEN ends_with(w, 'eed') AND {has(cut(3), M0)} THEN {cut(1)}
               ELSE left(w, length(w) - off) END AS w FROM p1b""",
    "p1d": f"""SELECT token, CASE WHEN off = 0 THEN w
               WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e'
               WHEN length(w) > 1 AND w[-1] = w[-2] AND NOT contains('aeiou', w[-1])
                 THEN CASE WHEN contains('lsz', w[-1]) THEN w ELSE {cut(1)} END
               WHEN {has('w', CVC)} THEN w || 'e' ELSE w END AS w FROM p1c""",
    "p1e": f"SELECT token, CASE WHEN ends_with(w, 'y') AND {has(cut(1), VOW)} THEN {cut(1)} || 'i' ELSE w END AS w FROM p1d",
    "p2": f"SELECT token, {suffix_case(PORTER_2, M0)} AS w FROM p1e",
    "p3": f"SELECT token, {suffix_case(PORTER_3, M0)} AS w FROM p2",
    "p4": f"""SELECT token, CASE WHEN ends_with(w, 'ion') THEN
                CASE WHEN {has(cut(3), MM)} AND {has(cut(3), '[st]$')} THEN {cut(3)} ELSE w END
              ELSE {suffix_case({s: '' for s in PORTER_4}, MM)} END AS w FROM p3""",
    "p5": f"""SELECT token, CASE WHEN ends_with(w, 'e') AND ({has(cut(1), MM)} OR ({has(cut(1), M1)} AND NOT {has(cut(1), CVC)}))
              THEN {cut(1)} ELSE w END AS w FROM p4""",
    "p6": f"SELECT token, CASE WHEN ends_with(w, 'll') AND {has('w', MM)} THEN {cut(1)} ELSE w END AS stem FROM p5",
    "vocab": f"SELECT token, stem, {case_lookup('stem', P.stem_map, 'stem')} AS term FROM p6",
}

# --- building blocks -------------------------------------------------------------------

POSITIVE_WORDS = values([(k, v) for k, v in P.lexicon.items()], "word, valence")
BOOST_WORDS = values([(k, v) for k, v in P.boosters.items() if k not in P.lexicon], "word, delta")
DROPPED = in_list(sorted(set(P.stopwords) | set(P.custom_stopwords)))

CTES = {
    "brands": BRANDS,
    "reviews": f"SELECT {', '.join(fx.REVIEW_COLUMNS)} FROM documents",
    **staged({"review_text": "reviewer_review", "review_title": "reviewer_title"}, "reviews"),
    "full_text": """SELECT *, trim(trim(concat(trim(review_title), '. ', trim(review_text)), '. ')) AS review_full_text
                    FROM clean_5""",
    "standard": f"""SELECT * EXCLUDE (reviewer_rating), {BRAND} AS brand,
                    TRY_CAST(reviewer_rating AS DOUBLE) AS reviewer_rating,
                    TRY_CAST(reviewer_published_date AS TIMESTAMP) AS review_date,
                    date_trunc('month', TRY_CAST(reviewer_published_date AS TIMESTAMP))::DATE AS review_month,
                    {words_of('review_full_text')} AS token_count FROM full_text""",
    "kept": f"""SELECT * FROM standard WHERE reviewer_rating BETWEEN {P.min_star} AND {P.max_star}
                AND token_count >= {P.min_tokens} AND review_full_text <> ''""",
    "first_copies": """SELECT * FROM kept
                QUALIFY row_number() OVER (PARTITION BY brand, reviewer_name, review_full_text ORDER BY row_ix) = 1""",
    "sample": f"""SELECT * REPLACE (CASE WHEN brand IN {in_list(P.brand_order)} THEN brand END AS brand),
                  {BRAND_ORD} AS brand_ord FROM first_copies""",
    # sentiment
    "lexicon": POSITIVE_WORDS,
    "boosters": BOOST_WORDS,
    "word_lists": rf"""SELECT row_ix, review_full_text AS txt,
                  regexp_extract_all(review_full_text, '[A-Za-z'']+') AS w FROM sample""",
    "words": "SELECT row_ix, txt, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM word_lists",
    "marked": f"""SELECT words.*, coalesce(l.valence, 0.0) AS base, coalesce(b.delta, 0.0) AS delta,
                  lower(tok) IN {in_list(P.negators)} AS neg, lower(tok) = 'but' AS is_but
                  FROM words LEFT JOIN lexicon l ON l.word = lower(tok) LEFT JOIN boosters b ON b.word = lower(tok)""",
    "looked_back": """SELECT *, lag(delta, 1, 0.0) OVER w AS d1, lag(delta, 2, 0.0) OVER w AS d2, lag(delta, 3, 0.0) OVER w AS d3,
                  lag(neg, 1, FALSE) OVER w OR lag(neg, 2, FALSE) OVER w OR lag(neg, 3, FALSE) OVER w AS negated,
                  min(CASE WHEN is_but THEN pos END) OVER (PARTITION BY row_ix) AS but_pos
                  FROM marked WINDOW w AS (PARTITION BY row_ix ORDER BY pos)""",
    "valences": f"""SELECT row_ix, pos, CASE WHEN base = 0 THEN 0.0 ELSE
                  (base + CASE WHEN tok = upper(tok) AND regexp_matches(txt, '[a-z]') THEN sign(base) * {CAPS_BOOST} ELSE 0 END
                   + sign(base) * (d1 * 1.0 + d2 * 0.95 + d3 * 0.9))
                  * CASE WHEN negated THEN {NEGATION} ELSE 1.0 END
                  * CASE WHEN pos < but_pos THEN 0.5 WHEN pos > but_pos THEN 1.5 ELSE 1.0 END END AS v FROM looked_back""",
    "sums": """SELECT row_ix, count(*) AS n, sum(v ORDER BY pos) AS s, coalesce(sum(v + 1 ORDER BY pos) FILTER (v > 0), 0) AS p,
               abs(coalesce(sum(v - 1 ORDER BY pos) FILTER (v < 0), 0)) AS m, count(*) FILTER (v = 0) AS z
               FROM valences GROUP BY row_ix""",
    "marks": r"""SELECT row_ix, length(review_full_text) - length(replace(review_full_text, '!', '')) AS ex,
               length(review_full_text) - length(replace(review_full_text, '?', '')) AS qu FROM sample""",
    "emphasis": f"""SELECT row_ix, {EXCLAMATION} * least(ex, 4)
                + CASE WHEN qu < 2 THEN 0 WHEN qu <= 3 THEN {QUESTION} * qu ELSE {QUESTION_MAX} END AS e FROM marks""",
    "parts": """SELECT sample.row_ix, coalesce(n, 0) AS n, s + sign(s) * e AS s, CASE WHEN p > m THEN p + e ELSE p END AS p,
                CASE WHEN p < m THEN m + e ELSE m END AS m, z
                FROM sample JOIN emphasis USING (row_ix) LEFT JOIN sums USING (row_ix)""",
    "polarity": """SELECT row_ix, CASE WHEN n = 0 THEN 0.0 ELSE round(m / (p + m + z), 3) END AS neg,
                CASE WHEN n = 0 THEN 0.0 ELSE round(z / (p + m + z), 3) END AS neu,
                CASE WHEN n = 0 THEN 0.0 ELSE round(p / (p + m + z), 3) END AS pos,
                CASE WHEN n = 0 THEN 0.0 ELSE round(s / sqrt(s * s + 15), 4) END AS compound FROM parts""",
    # dictionaries
    "coded": "SELECT *, "
    + ", ".join(f"({keyword_hits('review_full_text', ws)})::BIGINT AS aspect_{c}" for c, ws in P.aspects.items())
    + ", "
    + ", ".join(f"({keyword_hits('review_full_text', ws)})::BIGINT AS emotion_{c}" for c, ws in P.emotions.items())
    + " FROM sample",
    "scored": f"""SELECT coded.*, polarity.* EXCLUDE (row_ix), {top_category('aspect', P.aspects)}, {top_category('emotion', P.emotions)},
               CASE WHEN compound >= {P.positive_threshold} THEN 'positive' WHEN compound <= {P.negative_threshold} THEN 'negative'
               ELSE 'neutral' END AS sentiment_label FROM coded JOIN polarity USING (row_ix)""",
    # tokens
    "raw_lists": "SELECT row_ix, regexp_extract_all(lower(review_full_text), '[a-z]+') AS w FROM sample",
    "raw_token": f"""SELECT * FROM (SELECT row_ix, unnest(w) AS tok, generate_subscripts(w, 1) AS place_in_text FROM raw_lists)
                 WHERE tok NOT IN {in_list(P.stopwords)} AND length(tok) > 2""",
    **PORTER,
    "kept_vocab": f"SELECT token, term FROM vocab WHERE term NOT IN {DROPPED}",
    "tok": """SELECT row_ix, term, row_number() OVER (PARTITION BY row_ix ORDER BY place_in_text) - 1 AS pos
              FROM raw_token JOIN kept_vocab ON kept_vocab.token = raw_token.tok""",
    "doc_len": "SELECT row_ix, count(*) AS len FROM tok GROUP BY row_ix",
    "tf": "SELECT row_ix, term, count(*) AS tf FROM tok GROUP BY ALL",
    "term_stats": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY term",
    "features": f"""SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS term_ix FROM
                (SELECT * FROM term_stats WHERE df >= {P.min_df} AND df <= {P.max_df} * (SELECT count(*) FROM sample)
                 ORDER BY total DESC, term LIMIT {P.max_features})""",
    "tfidf_raw": """SELECT row_ix, term, term_ix, tf * (ln((1.0 + (SELECT count(*) FROM sample)) / (1 + df)) + 1) AS w
                FROM tf JOIN features USING (term)""",
    # given topics
    "given": """SELECT scored.*, (CASE reviewer_country WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END)::BIGINT AS dominant_topic_id,
             (CASE reviewer_country WHEN 'de' THEN 1 WHEN 'en' THEN 0 WHEN 'es' THEN -1 ELSE 2 END)::BIGINT AS cluster_id,
             (50 + token_count % 50) / 100.0 AS membership FROM scored""",
}


def ctfidf(prefix: str, topic: str) -> dict[str, str]:
    """c-TF-IDF and its top terms for one topic column of ``given``."""
    return {
        f"{prefix}_count_all": f"SELECT {topic} AS topic_id, term, count(*) AS f FROM tok JOIN given USING (row_ix) GROUP BY ALL",
        f"{prefix}_total": f"""SELECT term, sum(f) AS f_all FROM {prefix}_count_all GROUP BY term
                               ORDER BY f_all DESC, term LIMIT {P.max_features}""",
        f"{prefix}_count": f"SELECT * FROM {prefix}_count_all JOIN {prefix}_total USING (term)",
        f"{prefix}_length": f"SELECT topic_id, sum(f) AS f_topic FROM {prefix}_count GROUP BY topic_id",
        f"{prefix}_mean": f"""SELECT floor((SELECT sum(f_topic) FROM {prefix}_length) / (SELECT count(DISTINCT {topic}) FROM given)) AS a""",
        f"{prefix}_weight": f"""SELECT topic_id, term, f, ln(1 + a / f_all) AS idf, f / f_topic * ln(1 + a / f_all) AS weight
                                FROM {prefix}_count JOIN {prefix}_length USING (topic_id) CROSS JOIN {prefix}_mean""",
        f"{prefix}_ranked": f"""SELECT topic_id, term, weight, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank
                                FROM {prefix}_weight QUALIFY rank <= {P.top_words}""",
        f"{prefix}_label": f"""SELECT topic_id, string_agg(term, ' | ' ORDER BY rank) AS topic_label
                               FROM {prefix}_ranked WHERE rank <= 3 GROUP BY topic_id""",
        f"{prefix}_terms": f"SELECT topic_id, topic_label, rank, term, weight FROM {prefix}_ranked JOIN {prefix}_label USING (topic_id)",
    }


def coherence(prefix: str, terms: str, tokens: str) -> dict[str, str]:
    """c_v by listing every window start of every topic word."""
    w = P.coherence_window
    return {
        f"{prefix}_len": f"SELECT row_ix, count(*) AS len FROM {tokens} GROUP BY row_ix",
        f"{prefix}_total": f"SELECT sum(greatest(1, len - {w - 1})) AS n FROM {prefix}_len",
        f"{prefix}_starts": f"""SELECT DISTINCT row_ix, term, unnest(range(greatest(0, pos - {w - 1}),
                                least(pos, greatest(0, len - {w})) + 1)) AS start
                                FROM {tokens} JOIN {prefix}_len USING (row_ix) WHERE term IN (SELECT term FROM {terms})""",
        f"{prefix}_single": f"SELECT term, count(*) AS n FROM {prefix}_starts GROUP BY term",
        f"{prefix}_wanted": f"SELECT DISTINCT a.term AS a, b.term AS b FROM {terms} a JOIN {terms} b ON a.topic_id = b.topic_id AND a.term < b.term",
        f"{prefix}_pair": f"""SELECT a, b, count(*) AS n FROM {prefix}_starts x JOIN {prefix}_wanted ON x.term = a
                              JOIN {prefix}_starts y ON y.row_ix = x.row_ix AND y.start = x.start AND y.term = b GROUP BY a, b""",
        f"{prefix}_grid": f"""SELECT t.topic_id, t.topic_label, t.term AS w, u.term AS u, coalesce(sw.n, 0) / total.n AS pw,
                              coalesce(su.n, 0) / total.n AS pu,
                              coalesce(CASE WHEN t.term = u.term THEN sw.n ELSE p.n END, 0) / total.n AS pwu
                              FROM {terms} t JOIN {terms} u ON u.topic_id = t.topic_id CROSS JOIN {prefix}_total total
                              LEFT JOIN {prefix}_single sw ON sw.term = t.term LEFT JOIN {prefix}_single su ON su.term = u.term
                              LEFT JOIN {prefix}_pair p ON p.a = least(t.term, u.term) AND p.b = greatest(t.term, u.term)""",
        f"{prefix}_npmi": f"""SELECT *, CASE WHEN pw = 0 OR pu = 0 THEN 0.0 WHEN pwu = 1 THEN 1.0
                              ELSE ln((pwu + 1e-12) / (pw * pu)) / -ln(pwu + 1e-12) END AS x FROM {prefix}_grid""",
        f"{prefix}_sum": f"SELECT topic_id, u, sum(x) AS s FROM {prefix}_npmi GROUP BY ALL",
        f"{prefix}_word": f"""SELECT topic_id, topic_label, w, coalesce(sum(x * s) / nullif(sqrt(sum(x * x)) * sqrt(sum(s * s)), 0), 0) AS score
                              FROM {prefix}_npmi JOIN {prefix}_sum USING (topic_id, u) GROUP BY ALL""",
        f"{prefix}_topic": f"SELECT topic_id, topic_label, avg(score) AS score FROM {prefix}_word GROUP BY ALL",
    }


def coherence_rows(prefix: str, model: str) -> str:
    return f"""SELECT {q(model)} AS model, topic_id::VARCHAR AS topic_id, topic_label, {r6('score', 'coherence_cv')} FROM {prefix}_topic
               UNION ALL SELECT {q(model)}, 'overall', 'overall', {r6('avg(score)', 'coherence_cv')} FROM {prefix}_topic"""


LDA_LABEL = case_lookup("topic_id", P.lda_labels, "topic_label")
CTES |= {
    **ctfidf("gt", "dominant_topic_id"),
    **ctfidf("gc", "cluster_id"),
    "given_terms": f"SELECT *, {LDA_LABEL} AS publication_label FROM gt_terms",
    "given_reviews": f"""SELECT given.*, given.cluster_id AS bertopic_topic_id, l.topic_label AS dominant_topic_label,
        {case_lookup('dominant_topic_id', P.lda_labels, 'l.topic_label')} AS dominant_topic_publication_label,
        coalesce(c.topic_label, 'outlier') AS bertopic_topic_label,
        {rules_case("coalesce(c.topic_label, 'outlier')", CLUSTER_RULES, "coalesce(c.topic_label, 'outlier')")} AS bertopic_topic_publication_label
        FROM given LEFT JOIN gt_label l ON l.topic_id = dominant_topic_id
        LEFT JOIN (SELECT * FROM gc_label WHERE topic_id <> -1) c ON c.topic_id = given.cluster_id""",
    **coherence("cg", "given_terms", "tok"),
    "inside": "SELECT tok.* FROM tok JOIN given USING (row_ix) WHERE cluster_id <> -1",
    **coherence("cc", "gc_terms", "inside"),
    "label_names": f"""SELECT topic_label, {case_lookup('max(topic_id)', P.lda_labels, 'topic_label')} AS publication_label
                       FROM (SELECT DISTINCT topic_id, topic_label FROM given_terms) GROUP BY topic_label""",
    "topic_share": share_table("dominant_topic_label", "given_reviews"),
    "topic_dist": """SELECT brand, brand_ord, dominant_topic_label, n_reviews, pct_reviews,
                     coalesce(publication_label, dominant_topic_label) AS publication_label
                     FROM topic_share LEFT JOIN label_names ON topic_label = dominant_topic_label""",
    "aspect_share": share_table("aspect_top_category", "scored"),
    "constructs_id": values([(i, a, b) for i, (a, b) in LDA_CONSTRUCTS.items()], "topic_id, primary_construct, interpretation"),
    "id_constructs": """SELECT 'LDA' AS model, topic_id, publication_label, coalesce(primary_construct, '') AS primary_construct,
                        coalesce(interpretation, '') AS interpretation
                        FROM (SELECT DISTINCT topic_id, publication_label FROM given_terms) LEFT JOIN constructs_id USING (topic_id)""",
    "constructs_label": values([(k, a, b) for k, (a, b) in LANGUAGE_CONSTRUCTS.items()], "publication_label, primary_construct, interpretation"),
    "label_constructs": """SELECT 'BERTopic' AS model, '' AS topic_id, publication_label, coalesce(primary_construct, '') AS primary_construct,
                        coalesce(interpretation, '') AS interpretation
                        FROM (SELECT DISTINCT bertopic_topic_publication_label AS publication_label FROM given_reviews)
                        LEFT JOIN constructs_label USING (publication_label)""",
    "summary": """SELECT t.topic_id, t.publication_label, string_agg(term, ', ' ORDER BY rank) AS top_words,
                  any_value(c.score) AS coherence_cv_score, any_value(i.primary_construct) AS primary_construct,
                  any_value(i.interpretation) AS interpretation
                  FROM given_terms t LEFT JOIN cg_topic c USING (topic_id) LEFT JOIN id_constructs i ON i.publication_label = t.publication_label
                  GROUP BY t.topic_id, t.publication_label""",
    "brand_lines": """SELECT publication_label, string_agg(brand || ' (' || printf('%.1f%%', pct_reviews) || ')', '; ' ORDER BY r) AS top_brands
                  FROM (SELECT *, row_number() OVER (PARTITION BY publication_label ORDER BY pct_reviews DESC NULLS LAST, brand_ord) AS r FROM topic_dist)
                  WHERE r <= 2 GROUP BY publication_label""",
    "overall_aspects": """SELECT string_agg(aspect_top_category || ' (' || printf('%.1f%%', pct) || ')', '; ' ORDER BY pct DESC, aspect_top_category)
                  AS overall_top_aspects FROM (SELECT aspect_top_category, 100.0 * sum(n_reviews) / sum(sum(n_reviews)) OVER () AS pct
                  FROM aspect_share GROUP BY 1 ORDER BY pct DESC, 1 LIMIT 3)""",
    "review_rank": """SELECT row_ix, row_number() OVER (ORDER BY brand_ord NULLS LAST, review_date NULLS LAST, url NULLS LAST, row_ix) AS place
                  FROM scored""",
    "brand_stats": """SELECT brand, count(*) AS n_reviews, avg(token_count) AS mean_tokens, median(token_count) AS median_tokens,
                  sum(compound::DECIMAL(20, 10))::DOUBLE / count(*) AS mean_compound FROM scored GROUP BY brand""",
    "sentiment_share": share_table("sentiment_label", "scored"),
    "month_rows": "SELECT brand, review_month, sum(compound::DECIMAL(20, 10))::DOUBLE / count(*) AS mean_compound, count(*) AS n FROM scored WHERE review_date IS NOT NULL GROUP BY ALL",
    "planted": """SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n, min(vec_id) OVER (PARTITION BY label) AS first
                  FROM embeddings WHERE vec_id % 10 <> 0""",
    "planted_words": """SELECT row_ix, word_group, word_group || ((row_ix * 7 + j * j) % 10)::VARCHAR AS term
        FROM (SELECT doc_id AS row_ix, substr('abc', (doc_id % 3 + 1)::INTEGER, 1) AS word_group, unnest(range(0, 4 + n_chars % 5)) AS j FROM documents)""",
    "planted_ids": "SELECT label, row_number() OVER (ORDER BY n DESC, first) - 1 AS cluster_id FROM (SELECT DISTINCT label, n, first FROM planted)",
}


def statement(final: str) -> str:
    """``final`` with the CTEs it needs, each evaluated once.  A CTE reads only earlier ones."""
    names = list(CTES)
    needed: set[str] = set()

    def visit(sql: str, before: int) -> None:
        words = set(re.findall(r"\w+", re.sub(r"'(?:[^']|'')*'", "''", sql)))
        for i in range(before):
            if names[i] in words and names[i] not in needed:
                needed.add(names[i])
                visit(CTES[names[i]], i)

    visit(final, len(names))
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in names if n in needed)
    if head and final.startswith("WITH "):
        return f"WITH {head},\n{final[5:]}"
    return f"WITH {head}\n{final}" if head else final


def on_text(expr: str) -> str:
    return f"SELECT row_ix, {expr} AS out FROM reviews"


def label_counts(label: str, cte: str) -> str:
    return f"SELECT brand, {label}, n_reviews, {r6('pct_reviews')} FROM {cte}"


PUBLIC = ", ".join(
    f"round({c}, 6) + 0.0 AS {c}" if c in ("reviewer_rating", "compound", "pos", "neg", "neu") else c for c in PUBLIC_COLUMNS
)
EXPORT = ", ".join(
    f"round({c}, 6) + 0.0 AS {n}" if c in ("reviewer_rating", "compound", "pos", "neg", "neu") else f"{c} AS {n}"
    for c, n in EXPORT_COLUMNS.items()
)
MONTHLY = f"""SELECT g.brand, g.review_month, {r6('m.mean_compound', 'mean_compound', 12)}, coalesce(m.n, 0)::BIGINT AS n_reviews
    FROM (SELECT brand, review_month FROM brands CROSS JOIN (SELECT DISTINCT review_month FROM month_rows)) g
    LEFT JOIN month_rows m ON m.brand = g.brand AND m.review_month = g.review_month"""
BRAND_SUMMARY = f"""SELECT brands.brand, coalesce(n_reviews, 0)::BIGINT AS n_reviews, {r6('mean_tokens')}, {r6('median_tokens')}, {r6('mean_compound')}
    FROM brands LEFT JOIN brand_stats USING (brand)"""
RATING_COUNTS = """SELECT g.brand, g.reviewer_rating, coalesce(c.n, 0)::BIGINT AS n_reviews
    FROM (SELECT brand, reviewer_rating FROM brands CROSS JOIN (SELECT DISTINCT reviewer_rating FROM scored)) g
    LEFT JOIN (SELECT brand, reviewer_rating, count(*) AS n FROM scored GROUP BY ALL) c
      ON c.brand = g.brand AND c.reviewer_rating = g.reviewer_rating"""
DICTIONARY = values(
    [
        (group, c, i, k)
        for group, cats in (("aspect", P.aspects), ("emotion", P.emotions))
        for i, (c, ks) in enumerate(cats.items(), start=1)
        for k in ks
    ],
    "group_name, category, category_ord, keyword",
)

def poisson_weight(h: str) -> str:
    """SQL of a Poisson(1) number for a hash below 2**31 - 1, by its cumulative probabilities."""
    steps, term, total = [], Fraction(1), Fraction(0)
    for k in range(10):
        term = term / max(k, 1)
        total += term
        steps.append(int(2147483647 * float(total) / math.e))
    return "(" + " + ".join(f"({h} >= {step})::INTEGER" for step in steps) + ")"


FINALS = {
    "src_reviews": "SELECT * FROM reviews",
    "src_csv_tables": " UNION ALL ".join(
        f"SELECT {q(name)} AS table_name, concat_ws('|', {', '.join(keys)}) AS key, {r6(number, 'value', 12 if number == 'mean_compound' else 6)} FROM ({source})"
        for name, keys, number, source in [
            ("topic_coherence", ["model", "topic_id", "topic_label"], "coherence_cv", coherence_rows("cg", "LDA")),
            (
                "construct_mapping", ["model", "topic_id", "publication_label", "primary_construct", "interpretation"], "0.0",
                "SELECT * REPLACE (topic_id::VARCHAR AS topic_id) FROM id_constructs UNION ALL SELECT * FROM label_constructs",
            ),
            ("topic_terms", ["topic_label", "term", "publication_label"], "weight", "SELECT * FROM given_terms"),
            ("bertopic_terms", ["topic_label", "term"], "weight", "SELECT * FROM gc_terms"),
            ("topic_distribution_by_brand", ["brand", "dominant_topic_label", "publication_label"], "pct_reviews", "SELECT * FROM topic_dist"),
            ("aspect_distribution_by_brand", ["brand", "aspect_top_category"], "pct_reviews", "SELECT * FROM aspect_share"),
            ("monthly_sentiment_by_brand", ["brand", "review_month::VARCHAR"], "mean_compound", MONTHLY),
            ("sentiment_summary", ["brand", "sentiment_label"], "pct_reviews", "SELECT * FROM sentiment_share"),
        ]
    ),
    "src_params": f"""SELECT d.group_name, d.category, d.category_ord::BIGINT AS category_ord, d.keyword,
        count(*) FILTER (contains(' ' || lower(r.reviewer_review) || ' ', d.keyword)) AS n_reviews
        FROM ({DICTIONARY}) d CROSS JOIN reviews r GROUP BY ALL""",
    "sink_table": label_counts("aspect_top_category", "aspect_share"),
    "sink_public": f"SELECT {PUBLIC} FROM given_reviews",
    "sink_compressed": f"SELECT {PUBLIC} FROM given_reviews",
    "export_scored": f"SELECT {EXPORT} FROM given_reviews",
    "export_dist_renames": f"""SELECT brand, publication_label AS label, n_reviews, {r6('pct_reviews')} FROM topic_dist
        UNION ALL SELECT brand, aspect_top_category, n_reviews, {r6('pct_reviews')} FROM aspect_share""",
    "clean_newlines": on_text(newlines("reviewer_review")),
    "clean_mojibake": on_text(mojibake("reviewer_review")),
    "clean_whitespace": on_text(whitespace("reviewer_review")),
    "redact_email": on_text(email("reviewer_review")),
    "redact_phone": on_text(phone(email("reviewer_review"))),
    "std_brand": f"SELECT row_ix, {BRAND} AS brand FROM reviews",
    "compose_full_text": "SELECT row_ix, review_title, review_text, review_full_text FROM full_text",
    "parse_rating": "SELECT row_ix, reviewer_rating FROM standard",
    "parse_date": "SELECT row_ix, strftime(review_date, '%Y-%m-%d %H:%M:%S') AS review_date FROM standard",
    "derive_month": "SELECT row_ix, review_month FROM standard",
    "token_count": "SELECT row_ix, token_count FROM standard",
    "filter_sample": "SELECT row_ix, reviewer_rating, token_count, review_full_text FROM kept",
    "drop_contact_cols": "SELECT * EXCLUDE (email, phone) FROM reviews",
    "brand_domain": f"""SELECT row_ix, CASE WHEN brand IN {in_list(P.brand_order)} THEN brand END AS brand, {BRAND_ORD} AS brand_ord
        FROM (SELECT row_ix, {BRAND} AS brand FROM reviews)""",
    "sentiment_label": "SELECT row_ix, compound, sentiment_label FROM scored",
    "quote_excerpt": f"""SELECT row_ix, substr(replace(trim(review_full_text), chr(10), ' '), 1, {rp.QUOTE_LENGTH}) AS quote_excerpt
        FROM sample WHERE length(review_full_text) >= {rp.QUOTE_MIN_LENGTH}""",
    "round_summary": """SELECT row_ix, round_even(reviewer_rating, 3) AS mean_rating, round_even(token_count / 16.0, 3) AS mean_sentiment FROM scored""",
    "first_match_label": f"""SELECT row_ix, length(lower(reviewer_review)) AS n,
        {rules_case('reviewer_review', P.label_rules, "'raw'")} AS label FROM reviews""",
    "tokenize_alpha": "SELECT row_ix, array_to_string(regexp_extract_all(lower(reviewer_review), '[a-z]+'), ' ') AS tokens FROM reviews",
    "stopword_filter": f"""SELECT row_ix, array_to_string(list_filter(regexp_extract_all(lower(reviewer_review), '[a-z]+'),
        lambda t: t NOT IN {in_list(P.stopwords)}), ' ') AS tokens FROM reviews""",
    "token_normalize": "SELECT token, stem, term FROM vocab",
    "post_stopwords": "SELECT token, term FROM kept_vocab",
    "token_array": """SELECT row_ix, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS tokens FROM sample LEFT JOIN tok USING (row_ix)
        GROUP BY row_ix""",
    "doc_term_counts": "SELECT row_ix, term, term_ix, df, tf FROM tf JOIN features USING (term)",
    "tfidf": f"""SELECT row_ix, term, term_ix, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY row_ix))', 'weight')} FROM tfidf_raw""",
    "sentiment_scores": f"SELECT row_ix, {r6('neg')}, {r6('neu')}, {r6('pos')}, {r6('compound')} FROM polarity",
    "keyword_count": f"SELECT row_ix, ({keyword_hits('reviewer_review', [k for ks in P.aspects.values() for k in ks])})::BIGINT AS hits FROM reviews",
    "dict_scores": "SELECT row_ix, " + ", ".join([f"aspect_{c}" for c in P.aspects] + [f"emotion_{c}" for c in P.emotions]) + " FROM coded",
    "dict_top_category": "SELECT row_ix, aspect_top_category, emotion_top_category FROM scored",
    "lda_fit": """SELECT word_group, term, count(*) AS n FROM planted_words GROUP BY ALL""",
    "lda_topic_terms": """SELECT word_group, row_number() OVER (PARTITION BY word_group ORDER BY n DESC, term) AS rank, n,
        TRUE AS label_is_first_three, TRUE AS of_the_group
        FROM (SELECT word_group, term, count(*) AS n FROM planted_words GROUP BY ALL) QUALIFY rank <= 8""",
    "lda_doc_topics": """SELECT row_ix, word_group, round((1.0 / 3 + count(*)) / (1 + count(*)), 3) AS share FROM planted_words GROUP BY ALL""",
    "embed_svd": f"""WITH rows AS (SELECT doc_id AS row_ix, doc_id % 3 AS g, n_chars % 3 + 1 AS m FROM documents)
        SELECT row_ix, 3::BIGINT AS n_axes, {r6('4.0 * m * sum(m) OVER (PARTITION BY g)', 'with_all')}, {r6('4.0 * m * m', 'with_itself')} FROM rows""",
    "lda_doc_topics_hold": f"""SELECT row_ix, {P.lda_topics}::BIGINT AS n_topics, 1.0::DOUBLE AS total, TRUE AS dominant_is_heaviest
        FROM sample""",
    "lda_topic_terms_hold": f"""SELECT t AS topic_id, (SELECT string_agg(r::VARCHAR, ',' ORDER BY r) FROM range(1, {P.top_words + 1}) x(r)) AS ranks,
        TRUE AS weights_fall, TRUE AS label_is_first_three FROM range({P.lda_topics}) y(t)""",
    "embed_svd_products": f"""WITH weights AS (SELECT row_ix, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_ix)) AS w FROM tfidf_raw),
        whole AS (SELECT term, sum(w) AS s FROM weights GROUP BY term)
        SELECT row_ix, {r6('coalesce(sum(w * s), 0)', 'with_all')}, {r6('coalesce(sum(w * w), 0)', 'with_itself')}
        FROM sample LEFT JOIN (SELECT * FROM weights JOIN whole USING (term)) USING (row_ix) GROUP BY row_ix""",
    "density_clusters": """SELECT vec_id AS row_ix, coalesce(cluster_id, -1)::BIGINT AS cluster_id
        FROM embeddings e LEFT JOIN planted_ids p ON p.label = e.label AND e.vec_id % 10 <> 0""",
    "hierarchical_clusters": """SELECT vec_id AS row_ix, coalesce(cluster_id, -1)::BIGINT AS cluster_id
        FROM embeddings e LEFT JOIN planted_ids p ON p.label = e.label AND e.vec_id % 10 <> 0""",
    "ctfidf_terms": f"SELECT topic_id, topic_label, rank, term, {r6('weight')} FROM gt_terms",
    "topic_info": """WITH terms AS (SELECT row_ix, cluster_id AS topic_id, term, tf FROM tf JOIN given USING (row_ix)),
        cosines AS (SELECT row_ix, topic_id, sum(tf * idf * weight) / (sqrt(sum((tf * idf) ** 2)) *
            (SELECT sqrt(sum(weight ** 2)) FROM gc_weight x WHERE x.topic_id = terms.topic_id)) AS cosine
            FROM terms JOIN gc_weight USING (topic_id, term) GROUP BY row_ix, topic_id),
        closest AS (SELECT row_ix, topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY round(cosine, 9) DESC, row_ix) AS r
            FROM cosines QUALIFY r <= 3)
        SELECT g.cluster_id AS bertopic_topic_id, count(*) AS n_reviews,
            any_value(g.cluster_id::VARCHAR || '_' || n.name) AS Name, any_value(n.listed) AS Representation, any_value(d.docs) AS Representative_Docs
        FROM given g
        LEFT JOIN (SELECT topic_id, string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS name, string_agg(term, ', ' ORDER BY rank) AS listed
            FROM gc_terms GROUP BY topic_id) n ON n.topic_id = g.cluster_id
        LEFT JOIN (SELECT topic_id, string_agg(review_full_text, ' || ' ORDER BY r) AS docs FROM closest JOIN sample USING (row_ix)
            GROUP BY topic_id) d ON d.topic_id = g.cluster_id
        GROUP BY g.cluster_id""",
    "topic_assign": "SELECT row_ix, bertopic_topic_id, bertopic_topic_label FROM given_reviews",
    "topic_word_lists": "SELECT topic_id, string_agg(term, ' ' ORDER BY rank) AS terms FROM given_terms GROUP BY topic_id",
    "coherence_cv": coherence_rows("cg", "LDA"),
    "coherence_compare": coherence_rows("cg", "LDA") + " UNION ALL " + coherence_rows("cc", "BERTopic"),
    "apply_labels": f"""SELECT row_ix, dominant_topic_id,
        {case_lookup('dominant_topic_id', {i: x for i, x in P.lda_labels.items() if i < 3}, 'dominant_topic_label')} AS label FROM given_reviews""",
    "label_map_inverse": "SELECT topic_label, publication_label FROM label_names",
    "construct_map_ids": "SELECT * FROM id_constructs",
    "construct_map_labels": "SELECT * FROM label_constructs",
    "construct_union": """SELECT model, topic_id::VARCHAR AS topic_id, publication_label, primary_construct, interpretation FROM id_constructs
        UNION ALL SELECT * FROM label_constructs""",
    "rating_counts": RATING_COUNTS,
    "brand_summary": BRAND_SUMMARY,
    "sentiment_summary": label_counts("sentiment_label", "sentiment_share"),
    "monthly_sentiment": MONTHLY,
    "topic_distribution": f"SELECT brand, dominant_topic_label, n_reviews, {r6('pct_reviews')}, publication_label FROM topic_dist",
    "cluster_distribution": f"""SELECT brand, bertopic_topic_label, n_reviews, {r6('pct_reviews')}
        FROM ({share_table('bertopic_topic_label', 'given_reviews', 'bertopic_topic_id <> -1')})""",
    "aspect_prevalence": label_counts("aspect_top_category", "aspect_share"),
    "emotion_prevalence": " UNION ALL ".join(
        f"""SELECT brands.brand, {q(e)} AS emotion, count(*) FILTER (emotion_{e} > 0) AS n_reviews,
        {r6(f'100.0 * count(*) FILTER (emotion_{e} > 0) / greatest(count(scored.row_ix), 1)', 'pct_reviews')}
        FROM brands LEFT JOIN scored USING (brand) GROUP BY brands.brand"""
        for e in EMOTIONS
    ),
    "top_terms": """SELECT brand, rank, term, count FROM (SELECT brand, term, count(*) AS count,
        row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, min(place * 1000000 + tok.pos)) AS rank
        FROM tok JOIN scored USING (row_ix) JOIN review_rank USING (row_ix) WHERE brand IS NOT NULL AND length(term) > 3
        GROUP BY brand, term) WHERE rank <= 20""",
    "zero_fill": """SELECT g.reviewer_country, g.emotion_top_category, g.brand, g.brand_ord, coalesce(c.n, 0)::BIGINT AS n_reviews
        FROM (SELECT * FROM brands CROSS JOIN (SELECT DISTINCT reviewer_country, emotion_top_category FROM scored)) g
        LEFT JOIN (SELECT brand, reviewer_country, emotion_top_category, count(*) AS n FROM scored GROUP BY ALL) c
        USING (brand, reviewer_country, emotion_top_category)""",
    "pct_of_group": f"""SELECT reviewer_country, brand, brand_ord, n_reviews,
        {r6('100.0 * n_reviews / nullif(sum(n_reviews) OVER (PARTITION BY reviewer_country), 0)', 'pct_reviews')}
        FROM ({share_table('reviewer_country', 'scored')})""",
    "brand_summary_export": """SELECT brand, count(*) AS n_reviews, round_even(avg(reviewer_rating), 3) AS mean_rating,
        round_even(sum(compound::DECIMAL(20, 10))::DOUBLE / count(*), 3) AS mean_sentiment,
        round_even(100.0 * count(*) FILTER (sentiment_label = 'positive') / count(*), 3) AS pct_positive,
        round_even(100.0 * count(*) FILTER (sentiment_label = 'negative') / count(*), 3) AS pct_negative,
        round_even(100.0 * count(*) FILTER (sentiment_label = 'neutral') / count(*), 3) AS pct_neutral
        FROM scored WHERE brand IS NOT NULL GROUP BY brand""",
    "overall_top_aspects": "SELECT overall_top_aspects FROM overall_aspects",
    "topic_distinct_labels": "SELECT topic_id, topic_label FROM gt_label",
    "dedupe_keep_first": """SELECT row_ix, name, reviewer_name, reviewer_review FROM reviews
        QUALIFY row_number() OVER (PARTITION BY name, reviewer_name, reviewer_review ORDER BY row_ix) = 1""",
    "sort_reviews": "SELECT row_ix, brand, brand_ord, url FROM sample ORDER BY brand_ord, review_date, url, row_ix",
    "sort_dist": f"""SELECT emotion_top_category, brand, brand_ord, n_reviews, {r6('pct_reviews')}
        FROM ({share_table('emotion_top_category', 'scored')})""",
    "topk_terms_per_topic": """WITH r AS (SELECT topic_id, term, f, row_number() OVER (PARTITION BY topic_id ORDER BY f DESC, term) AS rank
        FROM gt_weight QUALIFY rank <= 15)
        SELECT topic_id, string_agg(term, ' | ') FILTER (rank <= 3) OVER (PARTITION BY topic_id ORDER BY rank
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS topic_label, rank, term, f::BIGINT AS weight FROM r""",
    "topk_brands_per_topic": "SELECT publication_label, top_brands FROM brand_lines",
    "topk_aspects_per_brand": """SELECT brand, string_agg(aspect_top_category || ' (' || printf('%.1f%%', pct_reviews) || ')', '; ' ORDER BY r) AS top_aspects
        FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY pct_reviews DESC NULLS LAST, aspect_top_category) AS r FROM aspect_share)
        WHERE r <= 2 GROUP BY brand""",
    "topic_summary": f"SELECT topic_id, publication_label, top_words, {r6('coherence_cv_score')}, primary_construct, interpretation FROM summary",
    "representative_quotes": f"""WITH first_texts AS (SELECT given.*, place, row_number() OVER (PARTITION BY dominant_topic_id, review_full_text
            ORDER BY membership DESC, abs(token_count - {rp.QUOTE_IDEAL_TOKENS}), compound, place) AS copy
            FROM given JOIN review_rank USING (row_ix) WHERE length(review_full_text) >= {rp.QUOTE_MIN_LENGTH}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY dominant_topic_id
            ORDER BY membership DESC, abs(token_count - {rp.QUOTE_IDEAL_TOKENS}), compound, place) AS quote_rank FROM first_texts WHERE copy = 1)
        SELECT dominant_topic_id AS topic_id, publication_label, quote_rank, brand, reviewer_rating,
            {r6('round_even(membership, 4)', 'membership_score')}, {r6('round_even(compound, 4)', 'compound_sentiment')},
            substr(review_full_text, 1, {rp.QUOTE_LENGTH}) AS quote_excerpt
        FROM ranked JOIN (SELECT DISTINCT topic_id, publication_label FROM summary) s ON s.topic_id = dominant_topic_id WHERE quote_rank <= 2""",
    "manuscript_table": f"""SELECT topic_id, publication_label AS lda_theme, primary_construct AS linked_construct, {r6('coherence_cv_score', 'coherence_cv')},
        top_words, top_brands, overall_top_aspects, interpretation
        FROM summary LEFT JOIN brand_lines USING (publication_label) CROSS JOIN overall_aspects""",
    "heatmap_terms": "SELECT term, "
    + ", ".join(f"min(rank) FILTER (topic_id = {i}) AS t{i}" for i in range(4))
    + " FROM given_terms WHERE rank <= 8 GROUP BY term",
    "union_all": f"""SELECT topic_id, topic_label, rank, term, {r6('weight')} FROM gt_terms
        UNION ALL SELECT topic_id, topic_label, rank, term, {r6('weight')} FROM gc_terms""",
    "sentiment_pivot": f"""SELECT brands.brand, {r6('any_value(mean_compound)', 'mean_compound')}, """
    + ", ".join(r6(f"coalesce(max(pct_reviews) FILTER (sentiment_label = '{x}'), 0)", x) for x in ("positive", "neutral", "negative"))
    + " FROM brands LEFT JOIN brand_stats USING (brand) LEFT JOIN sentiment_share USING (brand) GROUP BY brands.brand",
    "rating_corr": f"SELECT brand, {r6('corr(compound, reviewer_rating)', 'r')} FROM scored WHERE brand IS NOT NULL GROUP BY brand",
    "rating_regression": f"""SELECT brand, {r6('regr_slope(reviewer_rating, compound)', 'slope')},
        {r6('regr_intercept(reviewer_rating, compound)', 'intercept')} FROM scored WHERE brand IS NOT NULL GROUP BY brand""",
    "rating_regression_band": f"""SELECT brand, point, {r6('x')}, {r6('y')}, {r6('y_low')}, {r6('y_high')} FROM (
        WITH d AS (SELECT brand, row_ix, compound AS x, reviewer_rating AS y FROM scored
            WHERE brand IS NOT NULL AND compound IS NOT NULL AND reviewer_rating IS NOT NULL),
        h0 AS (SELECT d.*, r.range AS rep, (row_ix % 2147483647 * 16807) % 2147483647 AS a, ((r.range + 1) * 69621) % 2147483647 AS b
            FROM d, range(200) r),
        h1 AS (SELECT *, ((a + b) % 2147483647) AS h FROM h0),
        h2 AS (SELECT * REPLACE ((h * h + 12345) % 2147483647 AS h) FROM h1),
        h3 AS (SELECT * REPLACE ((h * 48271 + b) % 2147483647 AS h) FROM h2),
        h4 AS (SELECT * REPLACE ((h * h + a) % 2147483647 AS h) FROM h3),
        weighted AS (SELECT brand, rep, x, y, {poisson_weight('h * 16807 % 2147483647')} AS w FROM h4),
        sums AS (SELECT brand, rep, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
            FROM weighted GROUP BY brand, rep),
        slopes AS (SELECT *, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b FROM sums WHERE s * sxx - sx * sx > 1e-9 * s * s),
        ends AS (SELECT brand, min(x) AS low, max(x) AS high, regr_slope(y, x) AS m, regr_intercept(y, x) AS c FROM d GROUP BY brand),
        grid AS (SELECT brand, g.range::INTEGER AS point, low + (high - low) * g.range / 99 AS x, m, c FROM ends, range(100) g)
        SELECT brand, point, x, c + m * x AS y, quantile_cont((sy - b * sx) / s + b * x, 0.025) AS y_low,
            quantile_cont((sy - b * sx) / s + b * x, 0.975) AS y_high
        FROM grid JOIN slopes USING (brand) GROUP BY brand, point, x, m, c)""",
    "topic_dist_totals": f"""SELECT brand, dominant_topic_label, n_reviews, {r6('pct_reviews')}, publication_label,
        sum(n_reviews) OVER (PARTITION BY brand)::BIGINT AS total_n FROM topic_dist""",
    "coherence_plot_rows": f"SELECT 'LDA' AS model, topic_id::VARCHAR AS topic_id, topic_label, {r6('score', 'coherence_cv')} FROM cg_topic",
    "sample_reviews": """SELECT row_ix, brand, brand_ord, reviewer_rating, review_month, token_count, review_full_text FROM sample""",
}


def cells(tables: dict[str, tuple[str, list[str], list[str]]]) -> str:
    """Every value of ``tables`` in long form, from the SQL of the queries with the same rows."""
    parts = []
    for name, (source, text, numbers) in tables.items():
        key = ", ".join(f"{c}::VARCHAR" for c in text)
        values_ = [(c, f"{c}::VARCHAR", "NULL::DOUBLE") for c in text] + [(c, "NULL::VARCHAR", f"{c}::DOUBLE") for c in numbers]
        rows = ", ".join(f"{{'column_name': {q(c)}, 'text_value': {t}, 'number_value': {n}}}" for c, t, n in values_)
        parts.append(f"SELECT {q(name)} AS table_name, concat_ws('|', {key}) AS row_key, unnest([{rows}], recursive := true) FROM ({FINALS[source]})")
    return " UNION ALL ".join(parts)


FINALS["sink_bundle"] = cells(fx.BUNDLE_TABLES)
FINALS["publication_tables"] = cells(fx.PUBLICATION_TABLES)

ORACLES = {name: statement(sql) for name, sql in FINALS.items()}
