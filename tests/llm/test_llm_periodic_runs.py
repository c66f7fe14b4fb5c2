import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from reviewloom.llm import periodic_runs
from reviewloom.llm.queries import op11_periodic_runs, with_planted_runs

SF = "/root/testdata/sf0.01"


def brute_runs(words, min_length=24, min_exponent=3):
    """All runs, period by period, from the stretches on which words a period apart are equal."""
    n, found = len(words), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(min_length, min_exponent * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(brute_collapsed(words, runs)).hexdigest())


def test_cover_and_shifts():
    differences = {(a - b) % periodic_runs.MODULUS for a in periodic_runs.COVER for b in periodic_runs.COVER}
    assert differences == set(range(periodic_runs.MODULUS))
    for i in range(31):
        for j in range(31):
            d = periodic_runs._shifts()[i, j]
            assert {(i + d) % 31, (j + d) % 31} <= set(periodic_runs.COVER)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 40])
def test_common_extensions(alphabet):
    r = np.random.default_rng(alphabet)
    for n in (1, 2, 30, 31, 32, 200, 700):
        words = r.integers(0, alphabet, n)
        if n > 100:
            words[n // 2 :] = words[: n - n // 2]  # long agreements
        words = np.append(words, -1)
        suffixes = periodic_runs.SampledSuffixes(words)
        a, b = r.integers(0, n + 1, 300), r.integers(0, n + 1, 300)
        a, b = a[a != b], b[a != b]

        def common(x, y):
            t = 0
            while max(x, y) + t <= n and words[x + t] == words[y + t]:
                t += 1
            return t

        assert suffixes.common(a, b).tolist() == [common(x, y) for x, y in zip(a, b)]


def test_runs_of_many_texts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", 500)
    r = random.Random(3)
    texts = []
    for _ in range(150):
        words = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(0, 160))]
        for _ in range(r.randrange(3)):
            unit = [r.randrange(4) for _ in range(r.randrange(1, 12))]
            at = r.randrange(len(words) + 1)
            words[at:at] = unit * r.randrange(2, 9) + unit[: r.randrange(len(unit))]
        texts.append(words)
    for least, exponent in ((24, 3), (4, 2), (10, 4)):
        got = periodic_runs.find_runs(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]), least, exponent)
        want = [(i, *run) for i, t in enumerate(texts) for run in brute_runs(t, least, exponent)]
        assert [tuple(x) for x in got.tolist()] == want
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(None, 24, 1)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 30), (5, "a\x0bb\x0cc\r" * 9 + "d"), (6, "x y z " * 12), (7, "word " * 60_000), (7, "word " * 60_000)]
    rows += [(None, "b c " * 20), (8, "one text without repeats"), (9, "あ b \U0001f600 " * 10)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, collapsed string")
    got = periodic_runs.periodic_runs(docs.repartition(3), bytes_at_once=64).collect()
    want = []
    for i, text in rows:
        words = (text or "").encode().split()
        runs = brute_runs(words) if len(set(words)) != 1 or len(words) < 24 else [(0, len(words), 1)]
        want.append((i, [tuple(x) for x in runs], brute_collapsed(words, runs).decode()))
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert periodic_runs.periodic_runs(docs.filter("doc_id > 99")).collect() == []


def test_planting(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(400)] + [(None, "a b"), (5, None)], "doc_id long, text string")
    for row in with_planted_runs(docs).collect():
        if row.doc_id is not None and row.text is not None and zlib.crc32(str(row.doc_id).encode()) % 10 == 0 and row.doc_id % 40:
            words, g, n = [f"w{j}" for j in range(row.doc_id % 40)], zlib.crc32(str(row.doc_id).encode()) // 10, row.doc_id % 40
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert row.text.split(" ") == [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len(r.text or "") < 6000]
    assert len(short) > 0.8 * len(docs) and sum(got[r.doc_id][1] > 0 for r in short) > 20
    for r in short:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text)
