import random

import numpy as np
import xxhash

from reviewloom.llm import simhash
from reviewloom.session import materialise

WORDS = [a + b for a in "abcdefghij" for b in "klmnopqrst"]


def brute_fingerprint(text, size=4, seed=42):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, distance):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    nodes = sorted(fps)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in nodes}


def some_documents():
    r = random.Random(3)
    docs = []
    for i in range(120):
        words = [r.choice(WORDS) for _ in range(r.choice([0, 1, 3, 4, 5, 40, 300]))]
        docs.append((i, " ".join(words)))
        if i % 3 == 0 and len(words) > 30:
            for _ in range(3):  # near copies
                changed = list(words)
                changed[r.randrange(len(words))] = "zz"
                docs.append((1000 + len(docs), "\t".join(changed).upper()))
        if i % 5 == 0:
            docs.append((2000 + len(docs), " ".join(words)))
    return [*docs, (5000, None), (5001, "   \n"), (5002, ""), (None, docs[9][1]), (7, docs[7][1]), (8, "Éé ß  x y"), (5003, "long " * 30000)]


def test_near_duplicates_equal_brute_force(spark):
    rows = some_documents()
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    classes = brute_classes(set(fps), 4)
    least = {}
    for (doc, _), f in zip(rows, fps):
        if doc is not None:
            least[classes[f]] = min(doc, least.get(classes[f], doc))
    want = sorted(((doc is None, doc or 0), f, least[classes[f]]) for (doc, _), f in zip(rows, fps))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fp % (1 << 64), r.component_id) for r in got) == want
    assert len({c for _, _, c in want}) < len(want) - 30


def test_links_are_complete_also_in_tiles(spark):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(80)]
    for f in fps[:40]:
        for n in range(1, 7):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), n)))
    centre = r.getrandbits(64)
    fps += [centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)]  # a dense group in one bucket
    fps = sorted({0, *fps})
    df = materialise(spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long"), "fps")
    want = brute_classes(fps, 4)
    for tile_rows in (20_000, 10):
        roots = simhash.components(simhash.links(df, 4, 3, tile_rows))
        got = {f: f for f in fps}
        groups = {}
        for row in roots.collect():
            groups.setdefault(row.root, {row.root}).add(row.node)
        for members in groups.values():
            members = {m % (1 << 64) for m in members}
            for m in members:
                got[m] = min(members)
        assert got == want


def test_every_value_has_one_home_and_meets_all_neighbours():
    r = np.random.default_rng(2)
    for code in simhash.block_anchors(3, 4):
        fp = r.integers(0, 1 << 63, 50).astype(np.uint64)
        homes = {}
        for rows, anchor, home in code.of(fp):
            if home.all():
                homes = dict(zip(rows.tolist(), anchor.tolist()))
        for bit in range(21):
            moved = fp ^ (np.uint64(1) << (code.low + np.uint64(bit)))
            reach = set()
            for rows, anchor, home in code.of(moved):
                reach |= set() if home.any() else set(zip(rows.tolist(), anchor.tolist()))
            assert set(homes.items()) <= reach


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a long, b long")
    got = {tuple(r) for r in simhash.components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 301)} | {(901, 900)}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    clash = spark.createDataFrame([(1, "a b c d e", 9, 9, "x"), (2, "a b c d e", 9, 9, "x")], "doc_id long, text string, fp long, component_id long, anchor string")
    assert [tuple(r)[0::2] for r in simhash.near_duplicates(clash).orderBy("doc_id").collect()] == [(1, 1), (2, 1)]
