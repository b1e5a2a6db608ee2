"""Suffix arrays and repeated strings against counting every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from caudal.llm import registered, substring_dedup
from caudal.llm.suffix_array import SuffixArray

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, kept string, block string, body string"


def brute(texts, length):
    """Per text: bytes left, runs."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(r) else 0
        out.append((len(r), bytes(b for b, g in zip(r, gone) if not g), runs))
    return out


@pytest.mark.parametrize("depth", [3, 7, 8, 20, 40])
def test_suffix_array(depth):
    draw = random.Random(depth)
    for trial in range(12):
        letters = b"ab" if trial % 2 else b"abcdefgh"
        base = bytes(draw.choice(letters) for _ in range(250))

        def pieces():
            out = []
            for _ in range(draw.randint(1, 12)):
                a = draw.randrange(len(base) - 100)
                b = bytearray(base[a : a + draw.randint(depth, 100)])
                if draw.random() < 0.5:
                    b[draw.randrange(len(b))] = draw.choice(letters)
                out.append(bytes(b))
            return out

        mine, theirs = pieces(), pieces()
        array, other = SuffixArray(mine, depth), SuffixArray(theirs, depth)
        count = Counter(p[i : i + depth] for p in mine for i in range(len(p) - depth + 1))
        flags = array.repeated()
        for p, start in zip(mine, array.starts):
            for i in range(len(p)):
                assert flags[start + i] == (i <= len(p) - depth and count[p[i : i + depth]] > 1)
        for p, start in zip(theirs, other.starts):
            found = array.find(other, np.arange(max(0, len(p) - depth + 1)) + start)
            assert [f >= 0 for f in found] == [count[p[i : i + depth]] > 0 for i in range(len(found))]


@pytest.mark.parametrize("array_bytes", [60, 500, 10**6])
def test_arrays_are_merged_by_search(array_bytes):
    draw = random.Random(9)
    pieces, anchors = [], []
    for anchor in range(4):
        base = bytes(draw.choice(b"abcd") for _ in range(60))
        for _ in range(12):
            b = bytearray(base)
            b[draw.randrange(60)] = draw.choice(b"abcd")
            pieces.append(bytes(b[draw.randrange(20) :]))
            anchors.append(anchor)
    flags = substring_dedup.repeated_strings(pieces, np.array(anchors, np.uint64), 20, array_bytes)
    count = Counter((a, p[i : i + 20]) for a, p in zip(anchors, pieces) for i in range(len(p) - 19))
    for a, p, f in zip(anchors, pieces, flags):
        for i in range(len(p) - 19):
            assert not (count[a, p[i : i + 20]] > 1 and not f[i])
            if array_bytes == 10**6:
                continue
            assert not f[i] or sum(count[b, p[i : i + 20]] for b in set(anchors)) > 1


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("crowd, block_bytes", [(4096, 6_000_000), (0, 900), (2, 3000), (4096, 1200)])
def test_odd_texts(spark, crowd, block_bytes):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgé") for _ in range(draw.randint(2, 7)))
    passage = " ".join(word() for _ in range(30))
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 700), (5, "ab" * 300), (6, passage), (6, passage), (None, passage), (None, None)]
    for i in range(10, 60):
        text = " ".join(word() for _ in range(draw.randint(5, 60)))
        cut = draw.randrange(len(text))
        if i % 2:
            near = list(passage)
            near[draw.randrange(len(near))] = "Z"
            text = text[:cut] + ("".join(near) if i % 4 == 1 else passage[draw.randrange(60) :]) + text[cut:]
        rows.append((i, text))
    made = substring_dedup.repeats(documents(spark, rows), 50, crowd, block_bytes, gram=20, array_bytes=700).collect()
    expected = [(str(i), n, left, runs) for (i, _), (n, left, runs) in zip(rows, brute([t for _, t in rows], 50))]
    got = [(str(r["doc_id"]), r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in made]
    assert sorted(got) == sorted(expected)
    for r in made:
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"])


def test_no_rows(spark):
    assert substring_dedup.repeats(documents(spark, [])).count() == 0


def test_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = {}
    raw = {r["doc_id"]: r["text"].encode() for r in docs}
    count = Counter(hash(t[i : i + 400]) for t in raw.values() for i in range(len(t) - 399))
    for doc, t in raw.items():
        edge = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - 399):
            if count[hash(t[i : i + 400])] > 1:
                edge[i] += 1
                edge[i + 400] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0
        expected[doc] = (len(t), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    made = {r["doc_id"]: tuple(r)[1:5] for r in registered.op5_suffix_dedup(spark, SF).collect()}
    assert made == expected
    assert sum(e[1] for e in expected.values()) > 10_000


def test_plants_by_length(spark, tmp_path):
    """Passages of 300 to 600 bytes in two documents each: all of 400 bytes and more go, no clean document loses a byte."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))[:n]
    rows = [(i, text(2000)) for i in range(60)]
    planted = {}
    for k, size in enumerate(range(300, 601, 10)):
        passage = "\u00e9" + text(size - 2)
        for copy in range(2):
            planted[100 + 2 * k + copy] = size
            rows.append((100 + 2 * k + copy, text(700) + f"<{copy}" + passage + f"{copy}>" + text(700)))
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    made = {r["doc_id"]: r for r in registered.op5_suffix_dedup(spark, str(tmp_path)).collect()}
    for doc, r in made.items():
        size = planted.get(doc, 0)
        assert (r["n_removed"], r["removed"]) == ((size, True) if size >= 400 else (0, False))
        assert r["n_kept"] == r["n_bytes"] - r["n_removed"]
