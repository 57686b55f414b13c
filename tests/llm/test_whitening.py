"""op12 against exact fractions, its definition of whitening, and on awkward vectors."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from granary.llm import whitening

VECTORS = "vec_id long, embedding array<float>, component string, n int"


def _exact(vectors):
    """x, n*x - S and the covariance, in integers and fractions."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    return y, v


def _vectors(rng, n, d):
    basis = rng.normal(size=(d, d)) * np.geomspace(5, 0.05, d)
    return (rng.normal(size=(n, d)) @ basis + rng.normal(size=d) * 30).astype(np.float32).tolist()


@pytest.mark.parametrize("n,d", [(400, 12), (9000, 5), (30, 8)])
def test_equals_exact_covariance(spark, n, d):
    vectors = _vectors(np.random.default_rng(n), n, d)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    rows = df.selectExpr("vec_id", "cast(embedding AS array<double>) AS vector").repartition(7)
    total, sums, top = whitening.fit_sums(rows)
    y, v = _exact(vectors)
    assert total == n
    hi, lo = whitening.covariance(rows, total, sums, top)
    scale = max(abs(q) for r in v for q in r)
    assert all(abs(Fraction(float(hi[i, j])) + Fraction(float(lo[i, j])) - v[i][j]) <= scale / 2**98 for i in range(d) for j in range(d))
    got = defaultdict(dict)
    for r in whitening.whitened(df).collect():
        got[r["vec_id"]][r["component"]] = r
    z = np.array([[got[i][c]["whitened"] for c in range(1, min(8, d) + 1)] for i in range(n)])
    assert np.abs(z.T @ z / n - np.eye(z.shape[1])).max() < 1e-9
    values, q = np.linalg.eigh(np.array([[float(w) for w in r] for r in v]))
    for c in range(min(8, d)):
        e, w = values[-1 - c], q[:, -1 - c]
        want = np.array(y, dtype=float) / n @ w / np.sqrt(e)
        want *= np.sign(want @ z[:, c])
        assert np.abs(want - z[:, c]).max() < 1e-7
        assert abs(got[0][c + 1]["explained"] - e / values.sum()) < 1e-9
    for i in range(0, n, 29):
        r = got[i][1]
        assert r["deviation"] == sum(t * t for t in y[i]) and r["n"] == n and r["identity_error"] < 1e-9


def test_sum_of_products_is_exact_where_doubles_are_not():
    rng = random.Random(3)
    for bits in (10, 35, 60, 100):
        y = [[rng.randint(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(50)]
        hi, lo = whitening.outer_products(np.array(y, dtype=object if bits > 61 else np.int64), np.zeros((3, 3)), np.zeros((3, 3)))
        for i in range(3):
            for j in range(3):
                want = sum(r[i] * r[j] for r in y)
                assert abs(Fraction(float(hi[i, j])) + Fraction(float(lo[i, j])) - want) <= (2 ** (2 * bits + 6)) / Fraction(2**100)


def test_close_eigenvalues_get_accurate_vectors():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    want = np.sort(1 + np.arange(20) * 1e-7)[::-1]
    a = q.astype(np.longdouble) @ np.diag(want.astype(np.longdouble)) @ q.T.astype(np.longdouble)
    hi = a.astype(np.float64)
    e, v = whitening.eigen((hi + hi.T) / 2, np.zeros((20, 20)))
    assert np.abs(v.T @ v - np.eye(20)).max() < 1e-14 and np.abs(e - want).max() < 1e-13
    assert np.linalg.norm(hi @ v - v * e, axis=0).max() < 1e-14


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [1.0, inf, 1.0]), (6, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (8, [1.0, 2.5, 3.0]), (8, [1.0, 2.5, 3.0]), (9, [0.0, 0.0, 0.0]), (10, [3e38, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "c", 0) for r in rows], VECTORS)
    got = whitening.whitened(df.filter("vec_id IS NULL OR vec_id < 10")).collect()
    assert len(got) == 12 and {r["n"] for r in got} == {4} and {r["component"] for r in got} == {1, 2, 3}
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert by[9, 3]["whitened"] is None and by[9, 3]["explained"] == 0 and by[9, 1]["identity_error"] < 1e-9
    assert len(whitening.whitened(df).collect()) == 15 and {r["deviation"] for r in whitening.whitened(df).collect() if r["vec_id"] == 10} == {None}
    assert whitening.whitened(df.limit(0)).count() == 0
    one = whitening.whitened(df.filter("vec_id = 9")).collect()
    assert len(one) == 3 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in one)
