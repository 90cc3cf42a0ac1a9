"""Nearest rows in rounds of growing reach, against all pairs in plain Python."""

from __future__ import annotations

import numpy as np
import pytest

from pointlake.operators.nearest import nearest


@pytest.mark.parametrize("reach", [None, 0.3, 5.0])
def test_nearest_is_that_of_all_pairs(spark, reach):
    r = np.random.default_rng(5)
    at = np.round(r.normal(size=(120, 3)), 1)  # rounded: many equal distances
    at[100:110], at[119] = at[0], (40.0, 0.0, 0.0)
    rows = [(int(i), int(i % 2), *[float(v) for v in p]) for i, p in enumerate(at)]
    df = spark.createDataFrame([*rows, (500, 0, None, 0.0, 0.0), (501, None, 0.0, 0.0, 0.0), (502, 0, float("nan"), 0.0, 0.0)], "id long, g int, x double, y double, z double")
    gap = lambda a, b: ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) + (a[4] - b[4]) ** 2  # noqa: E731 (sum() would compensate)
    got = {}
    for f in nearest(df, df, 3, 2.0, ["g"], lambda a, b: b["id"] < a["id"], reach=reach).collect():
        got.setdefault(f.id, []).append((f.d2, f.id_r, f["rank"]))
    for a in rows:
        near = sorted((gap(a, b), b[0]) for b in rows if b[0] < a[0] and b[1] == a[1])
        want = [(d, b, n + 1) for n, (d, b) in enumerate([x for x in near if x[0] <= 4.0][:3])]
        assert sorted(got.get(a[0], []), key=lambda v: v[2]) == want
    assert not {500, 501, 502} & got.keys() and 119 not in got


@pytest.mark.parametrize("name", ["loop_first", "knn5_gate", "confusion_topn", "ring_constrained", "neighbour_covariance"])
def test_queries_make_no_table_of_all_pairs(spark, name, capsys):
    from pointlake.plans import catalog, more  # noqa: F401

    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan or "pointlake-" in plan
    assert "d2" not in "".join(line for line in plan.splitlines() if "SortAggregate" in line)
