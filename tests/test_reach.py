"""All pairs within a radius against plain loops, without a join of rows with rows."""

from __future__ import annotations

import numpy as np
import pytest

from pointlake.operators import joins, reach


@pytest.mark.parametrize("age", [5.0, 0.0, -3.0])
@pytest.mark.parametrize("least", [7, 512])
def test_older_rows_in_reach_without_a_join_of_rows(spark, monkeypatch, age, least):
    monkeypatch.setattr(joins, "radius_join", lambda *a, **k: pytest.fail("rows are copied to all neighbouring cells"))
    monkeypatch.setattr(reach, "LEAST", least)
    r = np.random.default_rng(3)
    at = np.vstack([r.normal(size=(60, 3)), r.normal(size=(20, 3)) * 6, np.repeat(r.normal(size=(2, 3)), 12, 0)]).round(2)
    rows = [(i, float(t), int(i % 2), *map(float, p)) for i, (t, p) in enumerate(zip(r.permutation(len(at)), at))]
    odd = [(900, 1.0, 0, None, 0.0, 0.0), (901, 1.0, None, 0.0, 0.0, 0.0), (902, 1.0, 0, float("nan"), 0.0, 0.0), (903, None, 0, 0.0, 0.0, 0.0), (904, 1.0, 0, float("inf"), 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "id long, t double, k long, x double, y double, z double")
    got = sorted(tuple(x) for x in joins.loop_candidates(df, 0.8, age, key=["k"]).collect())
    d2 = lambda a, b: (a[3] - b[3]) * (a[3] - b[3]) + (a[4] - b[4]) * (a[4] - b[4]) + (a[5] - b[5]) * (a[5] - b[5])
    want = sorted((a[2], a[0], b[0], d2(a, b)) for a in rows for b in rows if a[2] == b[2] and d2(a, b) <= 0.8 * 0.8 and a[1] - b[1] >= age)
    assert got == want and len(want) > 100


def test_no_rows(spark):
    assert joins.loop_candidates(spark.createDataFrame([], "id long, t double, x double, y double, z double"), 1.0, 1.0).count() == 0
