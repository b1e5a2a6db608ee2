"""Pair bitmaps and scores against plain Python with the public libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from caudal.llm import alignment
from caudal.llm.registered import op11_alignment, vocabulary

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(A_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.letters = byte_of()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text, num_threads=1):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if any(b"".join(x for _, x in side) != whole for side in (a, b)):
            return [], []
        return a, b

    def links(self, a, b):
        """Overlapping ranges, one by one, and the written groups."""
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, data in side:
                out.append((i, at, at + len(data)))
                at += len(data)
            spans.append(out)
        found, j = [], 0
        for i, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] < e:
                if spans[1][j][2] > s:
                    found.append((i, spans[1][j][0]))
                j += 1
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in spans))
            start = end
        return found, groups

    def rows(self, docs):
        made, counts, in_docs = [], Counter(), Counter()
        for doc, text in docs:
            a, b = self.tokens(text)
            links, groups = self.links(a, b)
            counts.update(links)
            in_docs.update(set(links))
            made.append((doc, len(a), len(b), groups, links))
        best = defaultdict(int)
        for (a, b), n in counts.items():
            best[b] = max(best[b], n)
        rows = [
            (
                doc, n_a, n_b, len(groups), len(links),
                sum(counts[x] == best[x[1]] for x in links),
                sum(counts[x] for x in links),
                hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            )
            for doc, n_a, n_b, groups, links in made
        ]
        return rows, counts, in_docs, best


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"]) < 4000]
    small = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    made = alignment.align(small, vocabulary(A_PATH), vocabulary(B_PATH), public_tokenizers.PATTERN, block_chars=100_000)
    expected = Brute().rows(docs)[0]
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted(expected, key=key)
    assert sum(r[1] > 0 for r in expected) > 0.9 * len(expected)


def test_registered_counts_every_link(spark):
    rows = op11_alignment(spark, SF).collect()
    tokenizer = Brute()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        a, b = tokenizer.tokens(docs[r["doc_id"]])
        assert (r["n_a"], r["n_b"]) == (len(a), len(b))
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n and\ttabs\x00 "), (5, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (6, "é ﬁ ▁x   　 日本語 😀👍🏽 ñandú"), (6, "the same id"), (None, "no id"), (None, "no id"), (7, "a" * 30_000),
    (8, " " * 20_000 + "end"), (9, "word " * 5_000), (10, "​﻿"), (11, "1234567890" * 50),
]
ODD += [(100 + i, "copies of one text, a third of all rows") for i in range(12)]


def test_odd_rows(spark):
    schema = "doc_id long, text string, block string, pair string, plane string, bits string, `a b` string"
    docs = spark.createDataFrame([(*r, "b", "p", "l", "i", "x") for r in ODD], schema).repartition(4)
    files = vocabulary(A_PATH), vocabulary(B_PATH)
    made = alignment.align(docs, *files, public_tokenizers.PATTERN, block_chars=300)
    expected, counts, in_docs, best = Brute().rows(ODD)
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted(expected, key=key)
    stored = alignment.postings(docs, *files, public_tokenizers.PATTERN)
    found = {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in alignment.pair_counts(stored, 32_000).collect()}
    assert found == {x: (in_docs[x], n, n == best[x[1]]) for x, n in counts.items()}
    assert alignment.align(docs.limit(0), *files, public_tokenizers.PATTERN).collect() == []
    none = alignment.align(docs.filter("doc_id <= 2"), *files, public_tokenizers.PATTERN).collect()
    assert sorted(tuple(r) for r in none) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_bitmaps():
    """What is set comes back, dense and sparse, with every multiplicity."""
    draw = np.random.default_rng(4)
    for n_docs in (1, 7, 64, 3000):
        pair, doc = draw.integers(0, 20, 5000) ** 2, draw.integers(0, n_docs, 5000)
        back = Counter()
        for pairs, plane, n, bits in alignment._inverted(pair, doc, n_docs):
            row, number = alignment._set_documents(bits, n, n_docs)
            assert sorted(np.bincount(row, minlength=len(n)).tolist()) == sorted(n.tolist())
            for r, d in zip(row, number):
                back[int(pairs[r]), int(d)] += 1 if plane < 0 else 1 << plane
        assert back == Counter(zip(pair.tolist(), doc.tolist()))
