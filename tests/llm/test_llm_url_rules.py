import random
import re

from reviewloom.llm.queries import URL_RULES
from reviewloom.llm.url_rules import url_verdicts


def brute(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v)
        for h, p, v in rules
        if h and p is not None and v is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else otherwise


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_verdicts(pages, table).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_registered_rules_on_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/a", "HTTP://x.net?q=/en/", "a://b://c.net/",
        "http://example.net/en/", "http://a.b.example.net/en/x?y", "http://example.net/en", "http://badexample.com/de/", "http://example.com/de/#x",
        "https://Ä.ORG/fr/é", "http://org/fr/", "http://x.org:80/fr/", "http://.net/", "http://net./", "ftp://a..net//", "http://x.net/" + "a/" * 3000,
        "http://" + "s." * 2000 + "net/", "http://x.net/\n/", "://x.net/en/", "http://x.net/", "http://x.net/",
    ]
    check(spark, urls, URL_RULES)


def test_random_urls_and_rules(spark):
    r = random.Random(6)
    host = lambda: ".".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "/", "x", "y"]) for _ in range(r.randint(0, 6)))
    rules = [*{(host(), path()): None for _ in range(60)}]
    rules = [(h, p, r.choice(["allow", "block"])) for h, p in rules] + [(None, "/", "block"), ("", "", "block"), ("a", None, "block"), ("a", "", None)]
    check(spark, [f"s://{host()}{path()}{r.choice(['', '?/x', '#'])}" for _ in range(400)], rules)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "http://x.net/"), (1, "http://x.net/"), (1, "http://x.net/"), (None, None)], "page_id long, url string")
    assert sorted(r.verdict for r in url_verdicts(pages, rules).collect()) == ["allow", "block", "block", "block"]
    assert [r.verdict for r in url_verdicts(pages, rules.limit(0), "block").collect()] == ["block"] * 4
    assert url_verdicts(pages.limit(0), rules).collect() == []


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = url_verdicts(pages, spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan.split("Physical Plan")[1]
