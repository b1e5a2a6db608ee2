"""Whitening against numpy's eigenvectors of the exact covariance, and odd tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from caudal.llm import whitening
from caudal.llm.registered import op13_whitening

SF = "/root/testdata/sf0.01"


def grid(vector):
    return tuple(math.floor(256 * c) + 0 for c in vector)


def brute(rows):
    """Rows as {vec_id: [(deviation, [whitened up to sign], [explained])]} by a dense eigenproblem."""
    usable = [(i, grid(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in usable})
    n, p = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(p)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(p)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:4]
    out = []
    for i, x in usable:
        d = sum((n * x[j] - sums[j]) ** 2 for j in range(p))
        c = np.array([float(Fraction(n * x[j] - sums[j], n)) for j in range(p)])
        out.append((i, n, d, c @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()))
    return out


def compare(made, rows):
    found = {}
    for r in made:
        found.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    expected = brute(rows)
    assert len(made) == 4 * len(expected)
    signs = None
    for i, n, d, w, e in sorted(expected, key=lambda t: -abs(t[3]).min()):
        mine = sorted(found[i, d], key=lambda r: r["component"])
        mine = mine[:: len(mine) // 4]  # a repeated row has all of its rows again
        got = np.array([r["whitened"] for r in mine])
        if signs is None:
            signs = np.sign(got * w)
        assert [r["component"] for r in mine] == [1, 2, 3, 4] and {r["n"] for r in mine} == {n}
        np.testing.assert_allclose(got, signs * w, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose([r["explained"] for r in mine], e, rtol=1e-10)
    assert len({r["identity_error"] for r in made}) == 1 and made[0]["identity_error"] < 1e-10


def test_whole_table(spark):
    made = op13_whitening(spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(made, rows)


def test_ill_conditioned(spark):
    """Directions with spreads from 1e6 to 1 and a sum of two others: no squared condition is lost."""
    draw = np.random.default_rng(1)
    x = draw.integers(-(10**6), 10**6, (400, 6)) // np.array([1, 10, 100, 10**4, 10**5, 10**6])
    x = np.concatenate([x, x[:, :1] + x[:, 1:2]], axis=1).astype(float) / 256
    rows = list(enumerate(x.tolist()))
    made = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=6).collect()
    assert {r["component"] for r in made} == {1, 2, 3, 4, 5, 6}
    last = np.array([r["whitened"] for r in made if r["component"] == 6])
    assert abs(last.mean()) < 1e-9 and abs((last**2).mean() - 1) < 1e-9
    assert made[0]["identity_error"] < 1e-9


def test_odd_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=5).tolist()) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(30)]  # a third are copies
    rows += [(3, rows[3][1]), (None, rows[4][1]), (91, None), (92, []), (93, [1.0, None, 0.0, 0.0, 0.0])]
    rows += [(94, [1.0, math.nan, 0.0, 0.0, 0.0]), (95, [1.0, math.inf, 0.0, 0.0, 0.0]), (96, [-0.0, 0.0, -1e-9, 0.0, 0.0])]
    schema = "vec_id long, embedding array<float>, x string, id string, v string, `n` string, `a b` string"
    odd = spark.createDataFrame([(*r, "x", "i", "v", "n", "a") for r in rows], schema)
    back = [(r["vec_id"], r["embedding"]) for r in odd.collect()]
    compare(whitening.whiten(odd).collect(), back)


def test_nothing_varies(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(i, [0.3, 2.0]) for i in range(5)], schema)).collect() == []
    flat = [(i, [0.3, float(i), 1.0]) for i in range(5)]
    made = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert {r["component"] for r in made} == {1} and made[0]["explained"] == pytest.approx(1)
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_large_entries(spark):
    """Deviations beyond 64 bits are null, those within are exact."""
    rows = [(i, [float(10**9 + i), float(i * i)]) for i in range(5)] + [(9, [1e12, 0.0])]
    made = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    fit = [grid(v) for _, v in rows]
    sums = [sum(x[j] for x in fit) for j in range(2)]
    for r in made:
        x = grid(dict(rows)[r["vec_id"]])
        d = sum((len(fit) * x[j] - sums[j]) ** 2 for j in range(2))
        assert r["deviation"] == (d if d < 2**63 else None)
