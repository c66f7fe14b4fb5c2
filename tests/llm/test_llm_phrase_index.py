import random
import re

from reviewloom.llm import phrase_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, benchmark in items:
            own = words_of(benchmark)
            n = min(window, len(own))
            if item is None or not own:
                continue
            grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(item)
        out.append((str(doc), len(words), len(hit), sorted(found)))
    return sorted(out)


def tables():
    r = random.Random(4)
    word = lambda: r.choice(["a", "B", "the", "é", "7x", "Zoë", "of"])
    text = lambda n: "".join(word() + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 6, 12]))) for i in range(12)] + [(3, "a a a"), (None, "the of"), (50, None), (51, " ,"), (52, "")]
    docs = [(i, text(r.choice([0, 1, 2, 30, 200]))) for i in range(60)] + [(5, "B the"), (None, text(40)), (70, None), (71, "")]
    docs.append((72, "x " * 3000 + items[4][1] + " y" * 3000))
    return docs, items


def test_contamination_equals_brute_force(spark, monkeypatch):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (2, 3, 10):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"])) for r in phrase_index.contamination(d, b, window).collect())
        assert got == brute(docs, items, window)


def test_many_segments_and_blocks_find_the_same(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    index = phrase_index.build_index(d, segment_words=30)
    assert index.count() > 5
    got = {tuple(r) for r in phrase_index.phrase_matches(index, b).collect()}
    want = set()
    for doc, text in docs:
        words = words_of(text)
        for item, benchmark in items:
            own = words_of(benchmark)
            if item is not None and own:
                want |= {(doc, item, i, len(own)) for i in range(len(words)) if words[i : i + len(own)] == own}
    assert got == want
    assert len(list(phrase_index.shared_rows(phrase_index.write_phrases(b, 3, block_phrases=10)))) > 3


def test_blocks_of_phrases_add_up(spark, monkeypatch):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    write = phrase_index.write_phrases
    monkeypatch.setattr(phrase_index, "write_phrases", lambda items, window: write(items.coalesce(1), window, 10))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r["items"])) for r in phrase_index.contamination(d, b, 3).collect())
    assert got == brute(docs, items, 3)


def test_proximity(spark):
    docs = [(1, "red fox jumps over a dog"), (2, "dog and so on and so on fox"), (3, "fox dog"), (4, "fox. " * 3 + "x " * 9 + "dog"), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = phrase_index.build_index(d)
    b = spark.createDataFrame([(9, "dog fox"), (10, "fox cat"), (11, None)], "item_id long, text string")
    assert {r.doc_id for r in phrase_index.proximity_matches(index, b, 4).collect()} == {1, 3}
    assert {r.doc_id for r in phrase_index.proximity_matches(index, b, 8).collect()} == {1, 2, 3}
    assert {(r.item_id) for r in phrase_index.proximity_matches(index, b, 100).collect()} == {9}


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", [3], 4)], "doc_id long, text string, items array<int>, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in phrase_index.contamination(docs, none).collect()] == [(1, 2, 0, [])]
    items = spark.createDataFrame([(1, "b", 3)], "item_id long, text string, doc_id int")
    assert [tuple(r) for r in phrase_index.contamination(docs, items).collect()] == [(1, 2, 1, [1])]
    assert phrase_index.contamination(docs.filter("doc_id > 5"), items).collect() == []
