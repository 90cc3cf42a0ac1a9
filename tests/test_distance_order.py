"""Descriptor distances against DuckDB's list functions, to the last digit, and alignments that are equally near."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd

from pointlake.functions import descriptor

SQL = """WITH c AS (SELECT n, [[x[j + 8 * r + 1] FOR r IN range(4)] FOR j IN range(8)] AS x, [[y[j + 8 * r + 1] FOR r IN range(4)] FOR j IN range(8)] AS y FROM pairs),
q AS (SELECT *, [list_sum([v * v FOR v IN c]) FOR c IN x] AS qx, [list_sum([v * v FOR v IN c]) FOR c IN y] AS qy, [list_avg(c) FOR c IN x] AS ax, [list_avg(c) FOR c IN y] AS ay FROM c),
e AS (SELECT n, k, list_sum([pow(ax[j + 1] - ay[(j - k + 8) % 8 + 1], 2) FOR j IN range(8)]) AS gap, list_avg(list_filter([CASE WHEN qx[j + 1] > 0 AND qy[(j - k + 8) % 8 + 1] > 0 THEN
 list_dot_product(x[j + 1], y[(j - k + 8) % 8 + 1]) / (sqrt(qx[j + 1]) * sqrt(qy[(j - k + 8) % 8 + 1])) END FOR j IN range(8)], lambda v: v IS NOT NULL)) AS sim FROM q, range(8) r(k))
SELECT n, 1 - arg_min(sim, k) AS dist FROM (SELECT * FROM e QUALIFY gap = min(gap) OVER (PARTITION BY n)) GROUP BY n ORDER BY n"""


def _sql(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    c = duckdb.connect()
    c.register("pairs", pd.DataFrame({"n": np.arange(len(x)), "x": list(x.reshape(len(x), -1)), "y": list(y.reshape(len(y), -1))}))
    return np.array([np.nan if d is None else d for _, d in c.sql(SQL).fetchall()])


def test_distances_are_those_of_sql_to_the_last_digit():
    r = np.random.default_rng(4)
    x, y = (r.normal(size=(2000, 4, 8)) * (r.random((2000, 4, 8)) < 0.5) for _ in "xy")
    x[7] = 0.0
    assert np.array_equal(descriptor.distances(x, y)[0], _sql(x, y), equal_nan=True)


def test_of_equally_near_alignments_one_with_a_common_column_counts():
    x, y = np.zeros((2, 1, 4, 8))
    x[0, :2, 0] = y[0, :2, 3] = 1.0, -1.0  # both means are zero, so all shifts are equally near
    dist, shift = descriptor.distances(x, y)
    assert abs(dist[0]) < 1e-12 and shift[0] == 5 and np.array_equal(dist, _sql(x, y))


def test_fused_is_rounded_once():
    r = np.random.default_rng(2)
    a, b = (r.normal(size=20000) * 10.0 ** r.integers(-4, 5, 20000) for _ in "ab")
    c = np.where(r.random(20000) < 0.5, -(a * b) * (1 + r.integers(-3, 4, 20000) * 2.0**-52), r.normal(size=20000))
    c[:100], a[50:150] = 0.0, 0.0
    assert np.array_equal(descriptor.fused(a, b, c), [math.fma(*v) for v in zip(a, b, c)])
