"""Whitening against exact covariances and numpy's eigenvectors."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from pointlake.llm import whiten

ROWS = "vec_id long, embedding array<float>, n int, component string"


def brute(vectors):
    """(n, whole numbers x, covariance): sums in whole numbers, products as fractions of n."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    far = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    cov = [[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)]
    return n, x, s, far, np.array(cov)


def rows_of(spark, pairs, parts=3):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in pairs], ROWS).repartition(parts)


def test_matches_exact_covariance(spark):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(160, 6)) @ rng.normal(size=(6, 6)) + [100, 0, -5, 0, 0, 3]).astype(np.float32)
    good = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    good += [(7, good[3][1]), (None, good[4][1])] + [(500 + i, good[0][1]) for i in range(80)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0, 2.0]), (905, []), (906, [3e38] * 6)]
    rows = rows_of(spark, good + bad)
    out = whiten.whitened(rows, whiten.fit(rows)).collect()
    n, x, s, far, cov = brute([v for _, v in good])
    val, vec = np.linalg.eigh(cov)
    val, vec = val[::-1], vec[:, ::-1]
    assert len(out) == 6 * len(good) and {r["n"] for r in out} == {n} and not {r["vec_id"] for r in out} & set(range(900, 910))
    want = {}
    for (i, _), xi, f in zip(good, x, far):
        w = (np.array([float(Fraction(n * a - b, n)) for a, b in zip(xi, s)]) @ vec) / np.sqrt(val)
        want.setdefault(i, []).append((f, np.abs(w)))
    for r in out:
        k = r["component"] - 1
        assert any(r["deviation"] == f and abs(abs(r["whitened"]) - w[k]) < 1e-9 for f, w in want[r["vec_id"]])
        assert abs(r["explained"] - val[k] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-9
    # one direction for all rows: products of two components average to nil
    by = {}
    for r in out:
        by.setdefault(r["component"], []).append((r["vec_id"] or -1, r["deviation"], r["whitened"]))
    w = np.array([[v for _, _, v in sorted(by[k])] for k in sorted(by)])
    assert np.allclose(w @ w.T / n, np.eye(6), atol=1e-9)


def test_flat_and_empty(spark):
    rows = rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 5.0])])
    out = whiten.whitened(rows, whiten.fit(rows)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in out) and len(out) == 6
    one = rows_of(spark, [(1, [1.0, 2.0])])
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in whiten.whitened(one, whiten.fit(one)).collect()} == {(None, None, None, 0)}
    none = rows_of(spark, [(1, None)]).where("vec_id < 0")
    assert whiten.fit(none) is None and whiten.whitened(none, None).collect() == []


def test_states_in_any_order():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (500, 9)) + 10**7
    whole = whiten._empty(9)
    whole.take(x)
    parts = whiten._empty(9)
    for at in (0, 1, 2, 130, 499):
        end = {0: 1, 1: 2, 2: 130, 130: 499, 499: 500}[at]
        one = whiten._empty(9)
        for row in x[at:end]:  # a row at a time
            one.take(row[None])
        parts.merge(one)
    want = np.cov(x.T, bias=True) * 500
    for s in (whole, parts):
        assert s.n == 500 and (s.sums == x.sum(0)).all() and np.allclose(s.moments, want, rtol=1e-10, atol=1e-6)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_symmetric_qr(d):
    rng = np.random.default_rng(d)
    for a in (rng.normal(size=(d, d)), np.diag(np.arange(d, dtype=float)), np.ones((d, d)), np.zeros((d, d))):
        a = a + a.T
        val, vec = whiten.symmetric_qr(a)
        assert np.allclose(val, np.linalg.eigvalsh(a)[::-1], atol=1e-10 * max(1, np.abs(a).max())) and np.allclose(vec.T @ vec, np.eye(d), atol=1e-12) and np.allclose(a @ vec, vec * val, atol=1e-9)


def test_deviation_beyond_a_long():
    m = whiten.Model(1, 10**9, np.array([0]), np.ones(1), np.eye(1), 1.0, np.ones(1))
    assert whiten.deviation(np.array([[3], [10]]), m) == [9 * 10**18, None]
