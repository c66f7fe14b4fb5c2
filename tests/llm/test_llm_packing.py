import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from reviewloom.llm import packing
from reviewloom.llm.queries import tokenizer_file

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(tokenizer_file())


def test_ids_are_those_of_the_library(model):
    r = random.Random(1)
    signs = list("ab Zé'\n\t  \r1½²!?.'srtmdvell÷×…漢字 ́😀\x1c\x85  _") + ["<|endoftext|>", "'ll", "'re", " 's"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    latin = list("ab Zéß'\n\t  \r19!?.'srtmdvell'' ")
    texts += ["".join(r.choice(latin) for _ in range(r.randint(0, 60))) for _ in range(5000)] + [""]
    got = packing.WordEncoder(tokenizer_file())([t.encode() for t in texts])
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want
    plain = Tokenizer.from_file(tokenizer_file())
    plain.encode_special_tokens = True  # strings of special tokens as ordinary text
    got = packing.WordEncoder(tokenizer_file(), added=False)([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_and_a_full_cache(model, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_BYTES", 400)
    encode = packing.WordEncoder(tokenizer_file())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 50 + "<|endoftext|>é漢", *map(str, range(300))]
    assert encode([t.encode() for t in texts])[0].tolist() == [64, 220, 50256, 275]
    for _ in range(2):
        assert [g.tolist() for g in encode([t.encode() for t in texts])] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert encode.kept_bytes < 400 + packing.ENTRY_BYTES + 100


def check_packing(rows, texts, model, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[doc], key=lambda r: r.piece)
        lengths = [len(ids) % capacity or capacity] + [capacity] * ((len(ids) - 1) // capacity)
        assert [r.length for r in mine] == lengths and [r.piece for r in mine] == list(range(len(lengths)))
        assert [r.start for r in mine] == np.cumsum([0, *lengths[:-1]]).tolist()
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_whole_table_round_trip(spark, model):
    docs = spark.read.parquet(DATA)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = packing.pack(docs.repartition(5), tokenizer_file()).collect()
    n = check_packing(rows, texts, model, 2048)
    assert len({r.doc_id for r in rows}) == len(texts)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1  # no packing could save more than one sequence


def test_odd_rows(spark, model):
    texts = [(1, None), (2, ""), (3, "a"), (4, "word " * 500), (5, "x y " * 4000), (6, "日本 " * 300), (7, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(*t, 7, 8) for t in texts], "doc_id long, text string, length int, task string")
    check_packing(packing.pack(docs, tokenizer_file(), 64).collect(), texts, model, 64)
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), tokenizer_file()).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3
    assert packing.pack(docs.filter("doc_id > 9"), tokenizer_file()).collect() == []


@pytest.mark.parametrize("kind", ["flat", "one", "short", "long", "gaps", "few"])
def test_plan_places_every_piece_once(kind):
    r = np.random.default_rng(8)
    h = np.zeros(257, np.int64)
    if kind == "flat":
        h[1:] = r.integers(0, 9, 256)
    elif kind == "one":
        h[100] = 1001
    elif kind == "short":
        h[1:9] = 90
    elif kind == "long":
        h[129:257] = 3
    elif kind == "gaps":
        h[[3, 77, 180, 256]] = [2000, 40, 33, 2]
    else:
        h[[5, 250]] = 1
    slots, n = packing.plan(h, 256)
    ranks = {}
    load = np.zeros(n, np.int64)
    for length, lo, hi, first, offset in slots.tolist():
        ranks.setdefault(length, []).append((lo, hi))
        load[first : first + hi - lo] += length
        assert offset + length <= 256
    for length, parts in ranks.items():
        parts = sorted(p for p in parts if p[0] < p[1])
        assert parts[0][0] == 0 and parts[-1][1] == h[length] and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert set(ranks) == set(np.flatnonzero(h).tolist()) and load.max(initial=0) <= 256 and load.min(initial=1) > 0
    rooms = []  # plain best fit, longest first
    for length in range(256, 0, -1):
        for _ in range(int(h[length])):
            fits = [room for room in set(rooms) if room >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 256) - length)
    assert -(-int((h * np.arange(257)).sum()) // 256) <= n <= len(rooms)
