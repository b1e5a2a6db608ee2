"""The trie against sorted arrays, scores against a dictionary of bigrams and trigrams."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from caudal.llm import lm, ngram_trie

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, score string, block string, body string"


@pytest.mark.parametrize("n, most", [(1, 0), (1, 10**12), (5, 3), (700, 100), (1000, 10**9), (20_000, 10**12)])
def test_monotone_sequences(n, most, monkeypatch):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, most + 1, n))
    level = ngram_trie.Monotone({f"x.{k}": v for k, v in ngram_trie.encode_monotone(values).items()}, "x")
    assert (level[np.arange(n)].astype(np.int64) == values).all()
    asked = np.concatenate((values, values + 1, draw.integers(0, most + 9, 500)))
    assert (level.successor(asked.astype(np.uint64)) == np.searchsorted(values, asked)).all()
    assert (level.run(n // 3, n) == values[n // 3 :].astype(np.uint64)).all() and (level.take(np.arange(n)[::-1]) == values[::-1]).all()
    distinct = np.unique(values)
    level = ngram_trie.Monotone({f"x.{k}": v for k, v in ngram_trie.encode_monotone(distinct).items()}, "x")
    monkeypatch.setattr(ngram_trie, "_RUN", 77)
    for some in (asked, asked[:1]):
        at, same = level.search(some.astype(np.uint64))
        assert (at == np.searchsorted(distinct, some)).all() and (same == np.isin(some, distinct)).all()


def test_trie_finds_all_pairs_and_no_others():
    draw = np.random.default_rng(1)
    pairs = {(int(a), int(b)): int(c) for a, b, c in zip(draw.integers(0, 300, 4000), draw.integers(0, 900, 4000), draw.integers(0, 255, 4000))}
    keys = sorted(pairs)
    contexts = np.array(sorted({a for a, _ in keys}))
    starts = np.searchsorted([a for a, _ in keys], np.concatenate((contexts, [10**6])))
    trie = ngram_trie.Trie(contexts, starts, np.array([b for _, b in keys]), np.array([pairs[k] for k in keys]))
    asked = np.arange(310).repeat(900), np.tile(np.arange(900), 310)
    got = trie.codes_of(np.arange(310), np.full(310, 900), asked[1])
    assert got.tolist() == [pairs.get((int(a), int(b)), 255) for a, b in zip(*asked)]
    trie.close()
    empty = ngram_trie.Trie(np.zeros(0, int), np.zeros(1, int), np.zeros(0, int), np.zeros(0))
    assert empty.codes_of(np.array([1]), np.array([2]), np.array([3, 4])).tolist() == [255, 255]
    empty.close()


def test_third_level():
    draw = np.random.default_rng(2)
    triples = {tuple(map(int, t)): int(draw.integers(0, 255)) for t in draw.integers(0, [20, 30, 40], (3000, 3))}
    pairs = sorted({t[:2] for t in triples})
    left = draw.integers(0, 255, len(pairs))
    keys = sorted(triples)
    contexts = np.array(sorted({a for a, _ in pairs}))
    starts = np.searchsorted([a for a, _ in pairs], np.append(contexts, 10**6))
    follow = np.searchsorted([pairs.index(k[:2]) for k in keys], np.arange(len(pairs) + 1))
    trie = ngram_trie.Trie(
        contexts, starts, np.array([b for _, b in pairs]), np.zeros(len(pairs)),
        (follow, np.array([k[2] for k in keys]), np.array([triples[k] for k in keys]), left),
    )
    places = trie.places_of(np.arange(22), np.full(22, 32), np.tile(np.arange(32), 22))
    leaves, codes = trie.codes_after(places, np.full(22 * 32, 42), np.tile(np.arange(42), 22 * 32))
    asked = [(a, b) for a in range(22) for b in range(32)]
    assert leaves.tolist() == [int(left[pairs.index(p)]) if p in pairs else 255 for p in asked]
    assert codes.tolist() == [triples.get((*p, c), 255) for p in asked for c in range(42)]
    trie.close()


def brute(rows, order=3):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]) for i, t in rows]
    single, double, triple = Counter(), Counter(), Counter()
    for i, w in words:
        if not held(i):
            single.update(w)
            double.update(zip([w[-1], *w], w))
            triple.update(zip([w[-1], *w], w, w[1:]))
    n, v = sum(single.values()), len(single)
    scale = n + 0.1 * (v + 1)
    out = []
    for i, w in words:
        base = sum(math.log10((single[x] + 0.1) / scale) for x in w)
        total = 0.0
        for at, (a, b) in enumerate(zip([w[-1], *w], w)):
            p, c = (single[b] + 0.1) / scale, single[a]
            m = 4 * c**0.8
            p = (double[a, b] + m * p) / (c + m) if c else p
            if order > 2 and at:
                before = w[at - 2] if at > 1 else w[-1]
                c = double[before, a]
                m = 4 * c**0.8
                p = (triple[before, a, b] + m * p) / (c + m) if c else p
            total += math.log10(p)
        out.append((i, held(i), len(w), sum(single[x] > 0 for x in w), n, base, total))
    return out


def compare(made, expected):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for got, want in zip(sorted(map(tuple, made), key=key), sorted(expected, key=key), strict=True):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5], rel=1e-9, abs=1e-9)
        assert abs(got[6] - want[6]) <= 0.051 * want[2]  # half a step for the bigram and for what its context leaves


@pytest.mark.parametrize("block_chars", [300, 12_000_000])
def test_odd_texts(spark, block_chars):
    rows = [
        (1, "The cat the CAT"), (2, None), (3, ""), (4, " \t\n"), (7, "the cat sat é É"), (7, "the cat sat é É"),
        (None, "the cat"), (None, None), (9, "a " * 30_000 + "b"), (10, "x" * 5000),
        *[(i, f"the cat sat on mat {i % 3}") for i in range(20, 60)],
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", "x", "y", "z") for i, t in rows], SCHEMA)
    for order in (2, 3):
        compare(lm.score(docs, block_chars, order).collect(), brute(rows, order))


def test_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = lm.score(docs, 400_000).collect()
    expected = brute(rows)
    compare(made, expected)
    got = {r["doc_id"]: r["score"] for r in made}
    error = [(got[r[0]] - r[6]) / r[2] for r in expected]
    assert abs(sum(error) / len(error)) < 0.003
    unseen = [r for r in made if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    pairs = {r["doc_id"]: r["score"] for r in lm.score(docs, 400_000, 2).collect()}
    assert sum(r["score"] for r in unseen) > sum(pairs[r["doc_id"]] for r in unseen)


def test_nothing_to_learn_or_score(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lm.score(none).count() == 0
    only = spark.createDataFrame([(None, "a b", "en", "s", "x", "y", "z")], SCHEMA)
    row = lm.score(only).first()
    assert (row["held_out"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (True, 0, 0, 0.0, 0.0)
