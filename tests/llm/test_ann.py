"""Nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caudal.llm import ann, hnsw, registered

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, class string, shard string, query string"


def brute(rows, asked, k):
    good = {
        (i, tuple(np.float32(v).tolist()))
        for i, v in rows
        if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)
    }
    out = set()
    for q, v in good:
        if asked(q):
            found = [(-math.fsum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(v) == len(w)]
            out |= {(q, n + 1, i, round(-s, 5)) for n, (s, i) in enumerate(sorted((round(s, 9), i) for s, i in found)[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [7, 8192])
def test_odd_vectors(spark, shard_rows):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 1) * (i % 3 + 1) for _ in range(4)]) for i in range(60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 160)]  # one common vector
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 2.0, 3.0]), (260, [math.nan, 1.0, 2.0, 3.0])]
    rows += [(280, [math.inf, 1.0, 2.0, 3.0]), (300, []), (320, [5.0, 1.0]), (340, [1.0, 7.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [rows[0], rows[20], (105, [1.0, 2.0, 3.0, 4.0])]
    table = spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], SCHEMA)
    made = ann.nearest(table, F.col("vec_id") % 20 == 0, 5, shard_rows=shard_rows).collect()
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 5)) for r in made}
    assert len(got) == len(made)
    assert got == brute(rows, lambda i: i % 20 == 0, 5)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_recall_of_the_query(spark):
    made = registered.op4_hnsw(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table], np.float64)
    where = {i: n for n, i in enumerate(ids)}
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[where[q]]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        rows = sorted((r for r in made if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(abs(r["score"] - score[where[r["vec_id"]]]) < 1e-12 for r in rows)
        hit += len(set(best) & {r["vec_id"] for r in rows})
        total += 20
    assert hit / total >= 0.97


def test_recall_over_shards(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(4000, 16)) * draw.uniform(0.2, 3, size=(4000, 1))
    graphs = [hnsw.build(x[i::2]) for i in range(2)]
    queries = x[::20]
    exact = np.argsort(-(queries @ x.T), axis=1)[:, :20]
    found = [hnsw.search(g, queries, ann.WIDTH)[:, :21] * 2 + i for i, g in enumerate(graphs)]
    hits = [len(set(e) & set(np.concatenate((a, b)))) for e, a, b in zip(exact, *found)]
    assert sum(hits) / exact.size >= 0.97
