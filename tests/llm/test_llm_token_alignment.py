import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewloom.llm import token_alignment
from reviewloom.llm.packing import byte_alphabet
from reviewloom.llm.queries import op13_token_alignment, tokenizer_file

SF = "/root/testdata/sf0.01"
A, B = tokenizer_file(), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    """Rows of the query from the libraries themselves, whole text by whole text."""
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        both = (
            [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
        )
        if any(b"".join(x) != (" " + text).encode() for x in both):
            return [], []
        out = []
        for x, pieces in zip(ids, both):
            at, places = 0, []
            for i, piece in zip(x, pieces):
                places.append((i, at, at + len(piece)))
                at += len(piece)
            out.append(places)
        return out

    def rows(docs):
        held, pairs, made = [], Counter(), []
        for doc, text in docs:
            x, y = tokens(text)
            ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
            groups, links, start = [], [], 0
            by_start = {s: n for n, (_, s, _) in enumerate(y)}
            xi = {s: n for n, (_, s, _) in enumerate(x)}
            for end in ends:
                i, j = xi[start], by_start[start]
                mine, other = [], []
                while i < len(x) and x[i][2] <= end:
                    mine.append(x[i])
                    i += 1
                while j < len(y) and y[j][2] <= end:
                    other.append(y[j])
                    j += 1
                groups.append((mine, other))
                links += [(p[0], q[0]) for p in mine for q in other if p[1] < q[2] and q[1] < p[2]]
                start = end
            pairs.update(set(links))
            text_of = ";".join(",".join(str(t[0]) for t in m) + "|" + ",".join(str(t[0]) for t in o) for m, o in groups)
            held.append((doc, len(x), len(y), groups, links, hashlib.sha256(text_of.encode()).hexdigest() if x else ""))
        best = Counter()
        for (p, _), n in pairs.items():
            best[p] = max(best[p], n)
        for doc, n_a, n_b, groups, links, digest in held:
            n_best = sum(pairs[link] == best[link[0]] for link in links)
            made.append((doc, n_a, n_b, len(groups), len(links), n_best, sum(pairs[link] for link in links), digest))
        return made, {link: n for link, n in pairs.items()}

    return rows


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def test_cuts_of_odd_texts_are_those_of_whole_texts(spark, brute):
    r = random.Random(13)
    signs = list("ab  Zé'\n\t  \r1½.,-_<>") + [" ", "　", "▁", "漢", "字 ", "́", "😀 ", "\x00", "\x1c", "\x85", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "'ll", " the", "ing "]
    docs = [(i, "".join(r.choice(signs) for _ in range(r.randrange(0, 40)))) for i in range(1500)]
    docs += [(2000, None), (2001, ""), (2002, " "), (2003, "  "), (2004, "a "), (2005, "a  "), (2006, "the " * 3000), (2007, "x" * 5000), (None, "a b"), (2006, "again"), (2006, "again")]
    want, pairs = brute(docs)
    df = spark.createDataFrame([(*d, 5, "c") for d in docs], "doc_id long, text string, n_a int, chunk string").repartition(3)
    got, others = token_alignment.align(df, A, B, chunk_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    same = token_alignment.Aligner(A, B).same
    assert {(x.a, x.b): x.n_docs for x in others.collect()} == {link: n for link, n in pairs.items() if same[link[0]] != link[1]}


def test_empty_table_and_texts_without_tokens(spark, brute):
    docs = [(i, f"some words and number {i} of {i * 7919}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    none = [(1, "▁"), (2, None), (3, "a ▁ b")]
    assert sorted(map(tuple, token_alignment.align(spark.createDataFrame(none, "doc_id long, text string"), A, B)[0].collect())) == brute(none)[0]
    assert sorted(map(tuple, token_alignment.align(df, A, B)[0].collect())) == sorted(brute(docs)[0])
    got, others = token_alignment.align(df.filter("doc_id > 99"), A, B)
    assert got.collect() == [] and others.collect() == []


def test_query_against_brute_force(spark, brute):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_token_alignment(spark, SF).collect()), key=key) == sorted(brute(docs)[0], key=key)
