"""Column expressions that clean, redact and parse one review."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom import params as P

# Java's \s is ASCII only; this is the Unicode set plus the separators U+001C..U+001F, split by
# whether a character fits in Latin-1, for which the pattern engine uses a bit table.
WHITESPACE_LATIN1 = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0]+"
WHITESPACE_BEYOND = r"[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WHITESPACE = WHITESPACE_LATIN1[:-2] + WHITESPACE_BEYOND[1:] + "+"
# the same characters one by one, without the plain space
WHITESPACE_NARROW = [*"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"]
WHITESPACE_WIDE = [chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def clean_newlines(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(plain, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def clean_mojibake(text: Column) -> Column:
    """Re-read the text as UTF-8 bytes seen through Latin-1, dropping whatever does not decode.

    Runs only where a tell-tale character occurs; an empty result keeps the old text.  Lossy by
    design: a correct ``château`` loses its ``â``.
    """
    # bytes that are U+FFFD in UTF-8 decode and stay: they pass as U+0000, which is put back as U+FFFD
    kept = F.replace(F.replace(text, F.lit(chr(0)), F.lit("")), F.lit("\xef\xbf\xbd"), F.lit(chr(0)))
    latin1 = F.encode(F.regexp_replace(kept, r"[^\x00-\xFF]", ""), "ISO-8859-1")
    decoded = F.replace(F.make_valid_utf8(latin1.cast("string")), F.lit(chr(0xFFFD)), F.lit(""))
    repaired = F.replace(decoded, F.lit(chr(0)), F.lit(chr(0xFFFD)))
    return F.when(_holds(text, [*P.MOJIBAKE_MARKS]), F.coalesce(F.nullif(repaired, F.lit("")), text)).otherwise(text)


def _holds(text: Column, parts: list[str]) -> Column:
    return reduce(or_, [text.contains(part) for part in parts])


def _once(text: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of a text that is evaluated once, however often ``step`` reads it."""
    return F.get(F.transform(F.array(text), step), F.lit(0))


def clean_whitespace(text: Column) -> Column:
    # contains() is a byte search and costs next to nothing beside a pattern, which would visit every single space
    def collapsed(t: Column) -> Column:
        wide = F.when(_holds(t, WHITESPACE_WIDE), F.regexp_replace(t, WHITESPACE, " "))
        return wide.when(_holds(t, WHITESPACE_NARROW + ["  "]), F.regexp_replace(t, WHITESPACE_LATIN1, " ")).otherwise(t)

    return F.trim(_once(text, collapsed))


def redact_email(text: Column) -> Column:
    # contains() is a byte search, and spares most texts the pattern
    masked = F.regexp_replace(text, "(?U)" + P.EMAIL_PATTERN, P.EMAIL_MASK)
    return F.when(text.contains("@"), masked).otherwise(text)


def redact_phone(text: Column) -> Column:
    # the core starts with one character class, and spares texts without a number of that length the look-behind
    def masked(t: Column) -> Column:
        return F.when(t.rlike("(?U)" + P.PHONE_CORE), F.regexp_replace(t, "(?U)" + P.PHONE_PATTERN, P.PHONE_MASK)).otherwise(t)

    return _once(text, masked)


def compose_full_text(title: Column, body: Column) -> Column:
    joined = F.concat(F.trim(title), F.lit(". "), F.trim(body))
    return F.trim(F.btrim(joined, F.lit(". ")))


def std_brand(name: Column, synonyms: dict[str, str]) -> Column:
    trimmed = F.trim(F.regexp_replace(name, rf"^{WHITESPACE}|{WHITESPACE}$", ""))
    return F.coalesce(lookup(trimmed, synonyms), trimmed)


def lookup(key: Column, mapping: dict) -> Column:
    """``mapping[key]`` for a small constant mapping; null where there is no entry."""
    if not mapping:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_rating(value: Column) -> Column:
    """A number in plain or exponent notation; null for anything else, such as ``1d``."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def parse_date(value: Column, formats: list[str]) -> Column:
    """First format that fits the trimmed text; null if none does.  Session time zone is UTC."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(value.cast("string")), F.lit(f)) for f in formats])


def derive_month(when: Column) -> Column:
    return F.trunc(when, "month")


def token_count(text: Column) -> Column:
    """Words of a text whose whitespace is already collapsed: its spaces plus one."""
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", 0).otherwise(spaces + 1).cast("long")


def quote_excerpt(text: Column, length: int = 600) -> Column:
    return F.substring(F.replace(F.trim(text), F.lit("\n"), F.lit(" ")), 1, length)


def percent_text(pct: Column) -> Column:
    """``12.3%`` with ties to even."""
    return F.format_string("%.1f%%", F.bround(pct, 1))
