"""Line features against plain Python, the chain against sums over all labellings, held-out accuracy."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from caudal.llm import crf, line_features, quality, registered

SCHEMA = "doc_id long, text string, lang string, source string, score string, good int, size string"
TEXTS = ["", "one line", "A\nB b\n\nC c c 12", None, "ÉTÉ été!!! ***\r\n" * 3, "word " * 5000, "\n\n", "x" * 300]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, "z") for i, t in rows], SCHEMA)


def test_lines_are_those_of_split():
    texts = [t or "" for t in TEXTS]
    rows, size, counts = line_features.features(pa.array(texts))
    assert counts.tolist() == [t.count("\n") + 1 for t in texts]
    assert size.tolist() == [len(line.encode()) for t in texts for line in t.split("\n")]
    assert rows.shape == (len(size), line_features.WIDTH)


def test_counts_of_classes_words_and_repeats():
    text = "The the the Dog! $$ 12,5\tdog dog"
    data, begin, end, _ = line_features.lines_of(pa.array([text]))
    counts, _ = line_features._counts(data, begin, end)
    words = text.split()
    again = sum(a == b for a, b in zip(words, words[1:]))
    assert counts[0].tolist() == [2, len(re.findall("[a-z]", text)), 3, 1, 3, len(words), again]


def test_features_do_not_depend_on_the_batch(monkeypatch):
    texts = [t or "" for t in TEXTS] + [" ".join(f"w{i} A!" for i in range(400)) + "\nend"]
    whole = line_features.features(pa.array(texts))[0]
    single = [line_features.features(pa.array([t]))[0] for t in texts]
    assert (np.concatenate(single) == whole).all()
    sliced = line_features.features(pa.array(["skip", *texts, "skip"]).slice(1, len(texts)))[0]
    assert (sliced == whole).all()
    monkeypatch.setattr(line_features, "_PIECE", 1000)
    pieces = line_features.features(pa.array(texts))[0]
    assert pieces.shape == whole.shape and (pieces != whole).sum() <= 2


def test_marginals_equal_the_sum_over_all_labellings():
    draw = np.random.default_rng(1)
    counts = np.array([1, 4, 6, 2])
    unary = draw.normal(size=counts.sum())
    moves = draw.normal(size=(2, 2))
    left, right = crf.forward_backward(unary, counts, moves)
    got = crf.sigmoid(left + right)
    at = 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(unary[at + t] * y[t] for t in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += weight
            good += weight * np.array(y)
        assert got[at : at + n] == pytest.approx(good / total)
        at += n


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    made = registered.op6_line_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = made.join(labels, "doc_id").filter("held_out").collect()
    assert made.count() == 10_000 and len(rows) > 500
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.98
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    assert sum(good) / len(good) > 0.99


def test_odd_rows_and_labels(spark):
    rows = [*enumerate(TEXTS), (None, "text"), (1, "again"), (1, "again")]
    docs = docs_of(spark, rows)
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, 1), (3, 0, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        made = quality.score(docs, quality.train(docs, table)).collect()
        assert len(made) == len(rows)
        assert all(0 <= r["score"] <= 1 for r in made)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), table)).count() == 0


def test_the_sample_is_bounded_in_rows_and_lines(spark):
    rows = [(1, "a\nb")] * 50 + [(i, f"text {i}\nend") for i in range(2, 30)] + [(30, "x\n" * 500)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 31)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    allowed = {r[0] for r in labels.filter(~quality.held_out()).select("doc_id").collect()}
    whole = sorted((t, i % 2) for i, t in rows if i in allowed)
    assert sorted(map(tuple, quality.sample(docs, labels).collect())) == whole
    for most, lines in ((20, 10_000), (4000, 30), (7, 9), (4000, 400)):
        made = [r["text"] for r in quality.sample(docs, labels, most, lines).collect()]
        assert 0 < len(made) <= most and sum(t.count("\n") + 1 for t in made) <= lines
