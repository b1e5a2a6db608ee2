"""The positional index and its search against plain Python."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.llm import phrase_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, segment string, doc string, term string, `a b` int"
ITEMS = "item_id long, text string, window string, class string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, length=10):
    """(doc_id, n_words, n_hit, sorted item ids) of every row."""
    wanted = {}
    for item, text in items:
        w = words(text)
        for at in range(max(len(w) - length, 0) + 1 if w else 0):
            wanted.setdefault(tuple(w[at : at + length]), set()).add(item)
    sizes = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for at in range(len(w) - size + 1):
                ids = wanted.get(tuple(w[at : at + size]))
                if ids:
                    hit |= set(range(at, at + size))
                    found |= ids
        out.append((doc, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return sorted(out, key=repr)


def found(spark, docs, items, **settings):
    d = spark.createDataFrame([(i, t, "s", "d", "t", 1) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "w", "c") for i, t in items], ITEMS)
    rows = phrase_index.contamination(d, b, **settings).collect()
    return rows, sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in rows), key=repr)


def test_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 3, 5])
    data, stops = phrase_index.to_varints(values)
    assert phrase_index.from_varints(data).tolist() == values.tolist() and stops[-1] == len(data)
    assert phrase_index.from_varints(phrase_index.to_varints(values[:0])[0]).tolist() == []


def test_phrases_of_few_words(spark):
    """A vocabulary of four words: overlaps, repeats and ties everywhere, many segments and slices."""
    draw = np.random.default_rng(3)
    def text(n):
        return " ".join(draw.choice(["a", "B", "ñ9", "c"], n))
    docs = [(i, text(draw.integers(0, 60))) for i in range(80)]
    items = [(i, text(draw.integers(0, 12))) for i in range(40)]
    rows, made = found(spark, docs, items, length=5, block_chars=200)
    assert made == brute(docs, items, 5)
    assert any(r["n_near"] for r in rows)


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(phrase_index, "_SEARCHED", 3)
    passage = " ".join(f"w{i}" for i in range(40))
    docs = [(1, passage), (2, passage[:90]), (3, "x " + passage.upper())]
    assert found(spark, docs, [(7, passage)])[1] == brute(docs, [(7, passage)])


def test_odd_rows(spark):
    passage = " ".join(f"word{i}" for i in range(15))
    docs = [(1, None), (2, ""), (None, passage), (None, passage), (3, passage), (3, passage + " and more"), (4, "..., !")]
    docs += [(5, passage.replace(" ", "\x00").title()), (6, "é" * 50_000), (7, ("x " * 30_000) + passage + " y" * 30_000)]
    docs += [(100 + i, passage) for i in range(40)]  # a third of all hold one passage
    docs += [(200 + i, f"nothing of it {i}") for i in range(60)]
    items = [(9, passage), (9, passage), (10, passage), (None, passage), (11, None), (12, ""), (13, "y"), (14, "é" * 50_000), (15, "absent word")]
    items += [(1000 + i, passage) for i in range(20)]
    assert found(spark, docs, items)[1] == brute(docs, items)


def test_empty(spark):
    assert found(spark, [], [(1, "a b")])[1] == []
    assert found(spark, [(1, "a b")], [])[1] == [(1, 2, 0, ())]


def test_proximity(spark):
    """Every word of the window may lie ``slop`` words off its place."""
    docs = spark.createDataFrame(
        [(1, "q the quick brown fox jumps"), (2, "the brown quick fox jumps"), (3, "the very quick brown fox jumps"), (4, "jumps fox brown quick the"), (5, "the quick"), (6, "brown fox jumps")],
        "doc_id long, text string",
    )
    wanted = spark.createDataFrame([("w", "the quick brown fox jumps".split())], "window string, terms array<string>")
    def of(slop):
        places, documents = phrase_index.matches(docs.coalesce(1), wanted, 5, slop)
        return sorted((r["doc_id"], r["start"], r["exact"]) for r in places.join(documents, ["segment", "doc"]).collect())
    assert of(0) == [(1, 1, True)]
    assert [(d, e) for d, _, e in of(1)] == [(1, True), (2, False), (3, False)]


def test_index_holds_every_token(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stored = phrase_index.index(docs, 12, 100_000)
    counts = {r["term"]: r["n"] for r in stored.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    expected = {}
    for r in docs.collect():
        for w in words(r["text"]):
            expected[w] = expected.get(w, 0) + 1
    assert counts == expected
    for r in stored.filter("term is not null").limit(200).collect():
        steps = phrase_index.from_varints(np.frombuffer(r["positions"], np.uint8))
        assert len(steps) == r["n"] and (steps[1:] > 0).all()


def test_hits_of_the_corpus(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    from caudal.llm.registered import op12_phrase_index

    made = {r["doc_id"]: r for r in op12_phrase_index(spark, sf).collect()}
    assert sum(r["contaminated"] for r in made.values()) > 10
    for doc, n, hit, ids in brute(docs, items):
        r = made[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(ids), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_starts(slop):
    """The intersection against looking at every place."""
    draw = np.random.default_rng(slop)
    for _ in range(100):
        text = draw.integers(0, 4, 40)
        window = draw.integers(0, 4, 5)
        lists = {str(t): np.flatnonzero(text == t) for t in range(4)}
        order = sorted(range(5), key=lambda o: (len(lists[str(window[o])]), o))
        terms, offsets = [str(window[o]) for o in order], order
        start, exact = phrase_index.starts_of({k: v for k, v in lists.items() if len(v)}, terms, offsets, slop)
        expected = {}
        for s in range(-10, 50):
            away = [min((abs(p - s - o) for p in np.flatnonzero(text == window[o])), default=99) for o in range(5)]
            if all(a <= slop for a in away):
                expected[s] = not any(away)
        firsts = [s for s in expected if expected[s] or s - 1 not in expected]
        kept = [s for s in firsts if expected[s] or not any(expected.get(s + d) for d in range(-slop, slop + 1))]
        assert list(zip(start.tolist(), exact.tolist())) == [(s, expected[s]) for s in kept]
