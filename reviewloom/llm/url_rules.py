"""URL verdicts from host and path rules, by hashed expressions.

A rule's key is its host joined to its path up to the last slash.  A URL is expanded into every joint of a
host suffix and a path prefix that ends in a slash, as deep as any rule goes; expressions and keys meet in
an equi-join on the first eight hex digits of their SHA-256, after which the full digest and the rest of
the rule's path are confirmed and the longest rule wins.  Column expressions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the join is on.
PREFIX = 8


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """All host suffixes of up to ``labels`` labels, each with all path prefixes of up to ``depth`` slashes."""
    names, parts = F.split(host, r"\."), F.split(path, "/")
    n_names, n_parts = F.size(names), F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n_names, F.lit(labels))),
        lambda n: F.array_join(F.slice(names, n_names - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(n_parts - 1, F.lit(depth))),
        lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def url_verdicts(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url; other columns are ignored).

    ``rules`` are (host, path, verdict).  A rule fits its host and all subdomains, if the URL's path starts
    with the rule's.  The longest rule (host and path) wins; of equally long ones that with the longer host,
    then ``block`` before others.  Without a fitting rule ``rule`` is null and the verdict ``otherwise``.
    A null URL, or one without ``://``, has an empty host and path.  Repeated rows and null ids are kept.
    Rules with a null or empty host, or a null path or verdict, fit nothing; no rules at all leave all URLs
    to ``otherwise``.
    """
    folder = F.regexp_extract("path", "^(.*/)?", 0)
    known = rules.filter("host <> '' and path is not null and verdict is not null").select(
        F.col("host").alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
        F.sha2(F.concat("host", folder), 256).alias("rule_digest"),
    )
    most = known.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)),
        F.coalesce(F.max(F.size(F.split("rule_path", "/")) - 1), F.lit(0)),
    ).first()
    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    digests = F.transform(expressions(F.col("host"), F.col("path"), *most), lambda e: F.sha2(e, 256))
    opened = parts.select("row", "page_id", "host", "path", F.explode_outer(digests).alias("digest"))
    meets = (
        (F.substring("digest", 1, PREFIX) == F.substring("rule_digest", 1, PREFIX))
        & (F.col("digest") == F.col("rule_digest"))
        & F.startswith(F.col("path"), F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(
        F.length(rule).alias("length"),
        F.length("rule_host").alias("host_length"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        rule.alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = F.max(F.when(F.col("rule_digest").isNotNull(), rank))
    found = opened.join(known, meets, "left").groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
