"""Hand-checkable cases: quirks, geometry, assignment, chains, fits."""

from __future__ import annotations

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.functions import descriptor, geometry, nmea, polygon, voxels
from pointlake.operators import cluster, models, sets, windows


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_voxel_of_negatives_and_angle(spark):
    r = one(spark, v=geometry.voxel(F.lit(-0.5), 1.0), a=geometry.quadrant_angle(F.lit(-1.0), F.lit(1.0)))
    assert r["v"] == -1 and r["a"] == pytest.approx(135)


def test_transform_inverse_and_euler(spark):
    t = geometry.from_euler(1.0, 2.0, 3.0, 0.1, 0.2, 0.3)
    assert np.allclose(geometry.composed(t, geometry.inverse(t)), [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0])
    r = one(spark, **dict(zip(("r", "p", "y"), geometry.to_euler([F.lit(v) for v in t]))))
    assert (r["r"], r["p"], r["y"]) == pytest.approx((0.1, 0.2, 0.3))


def test_quaternion_pole(spark):
    h = 0.5**0.5
    r = one(spark, **dict(zip("rpy", geometry.quaternion_euler(F.lit(0.0), F.lit(h), F.lit(0.0), F.lit(h)))))
    assert r["p"] == pytest.approx(np.pi / 2)


def test_nmea_checksum_77_is_wrong(spark):
    s = "$GPGGA,092725.00,3937.3032,N,11627.1200,E,1,08,1.03,61.7,M,55.2,M,,*75"
    r = one(spark, ok=nmea.valid(F.lit(s)), bad=nmea.valid(F.lit(s[:-2] + "77")), none=nmea.valid(F.lit("junk")))
    assert r["bad"] is False and r["none"] is False and r["ok"] is (functools.reduce(lambda a, c: a ^ ord(c), s[1:-3], 0) == 0x75)


def test_descriptor_shift_and_similarity(spark):
    rng = np.random.default_rng(1)
    a = rng.random((4, 6)).round(3)
    df = spark.createDataFrame([(a.ravel().tolist(), np.roll(a, 2, 1).ravel().tolist(), [0.0] * 24)], "a array<double>, b array<double>, z array<double>")
    r = df.select(descriptor.shifted(F.col("a"), 2, 4, 6).alias("s"), F.col("b"), descriptor.similarity(4, 6)("a", "b").alias("sim"), descriptor.distance(4, 6)("a", "b").alias("d"), descriptor.column_cosine(F.col("a"), F.col("z"), 4, 6).alias("n"), descriptor.similarity(4, 6)("a", "z").alias("sz")).first()
    assert r["s"] == r["b"] and r["sim"] == pytest.approx(1) and r["d"]["dist"] == pytest.approx(0, abs=1e-9) and r["n"] is None and r["sz"] is None


def test_polygons():
    sq = lambda m: [(m, 0), (m + 1, 0), (m + 1, 1), (m, 1)]
    assert polygon.overlap(sq(0), sq(2))[0] == 0 and polygon.overlap(sq(0), sq(0.5))[0] == pytest.approx(0.5)
    assert polygon.area(polygon.hull([(0, 0), (2, 0), (1, 0.5), (2, 2), (0, 2)])) == 4
    assert polygon.crossing((0, 0), (2, 2), (0, 2), (2, 0)) == pytest.approx([1, 1]) and polygon.crossing((0, 0), (1, 0), (0, 1), (1, 1)) is None


def test_walk():
    assert voxels.walk([0.5, 0.5, 0.5], [3.5, 0.5, 0.5], 1.0) == [(i, 0, 0) for i in range(4)]
    assert voxels.walk([0.5, 0.5, 0.5], [-1.5, 0.5, 0.5], 1.0)[-1] == (-2, 0, 0)


def test_hungarian_against_all_permutations():
    from itertools import permutations

    assert cluster.hungarian(np.array([[1, 2], [2, 4]])).tolist() == [1, 0]
    rng = np.random.default_rng(0)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        c = rng.random((n, m))
        got = cluster.hungarian(c)
        cost = sum(c[i, j] for i, j in enumerate(got) if j >= 0)
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(range(n), p)) for p in permutations(range(m), n)) if n <= m else min(sum(c[i, j] for j, i in enumerate(p)) for p in permutations(range(n), k))
        assert cost == pytest.approx(best)


def test_viterbi_and_fits():
    assert models.viterbi(np.array([0, 0, 1, 1]), np.array([0.5, 0.5]), np.array([[0.8, 0.2], [0.2, 0.8]]), np.array([[0.9, 0.1], [0.1, 0.9]]))[0] == [0, 0, 1, 1]
    rng = np.random.default_rng(3)
    p = rng.normal(size=(60, 3))
    t = geometry.from_euler(0.1, -0.1, 0.05, 0.02, 0.01, 0.05)
    m = np.array(t).reshape(3, 4)
    r, tr, e = models.icp(p, p @ m[:, :3].T + m[:, 3])
    assert np.allclose(np.hstack([r, tr[:, None]]), m, atol=1e-6) and e < 1e-9
    a = rng.random(200) * 2 * np.pi
    c = models.cylinder_of(np.stack([np.cos(a) * 0.3 + 5, np.sin(a) * 0.3 - 2, rng.random(200) * 3], 1))
    assert c[2] == pytest.approx(0.3, abs=1e-6) and abs(c[1][2]) == pytest.approx(1)
    flat = np.stack([rng.random(50), rng.random(50), np.zeros(50)], 1)
    assert abs(models.normal_of(flat)[2]) == pytest.approx(1) and models.normal_of(flat[:2]) is None
    x = models.pose_graph(4, [(0, 1, 1, 0, np.pi / 2, 1), (1, 2, 1, 0, np.pi / 2, 1), (2, 3, 1, 0, np.pi / 2, 1), (3, 0, 1, 0, np.pi / 2, 1)], np.zeros(3))
    assert np.allclose(x[:, :2], [[0, 0], [1, 0], [1, 1], [0, 1]], atol=1e-6)


def test_first_acceptable_keeps_visit_order(spark):
    df = spark.createDataFrame([(1, 0, 0.4), (1, 1, 0.3), (1, 2, 0.1), (2, 0, 0.45), (2, 1, 0.42), (3, 0, 0.9)], "k long, v long, s double")
    got = {r["k"]: r["v"] for r in sets.first_acceptable(df, ["k"], "v", "s").collect()}
    assert got == {1: 1, 2: 1}


def test_islands_and_majority_reset(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([True, True, False, False, True])], "k long, p long, f boolean")
    got = windows.islands(df, F.col("f"), ["k"], ["p"]).groupBy("island").count().orderBy("island").collect()
    assert [r["count"] for r in got] == [2, 2, 1]
    df = spark.createDataFrame([(1, i, True) for i in range(15)], "k long, p long, f boolean")
    won = [r["voted"] for r in windows.majority_reset(df, "f", ["k"], ["p"], "k long, p long, f boolean").orderBy("p").collect()]
    assert won.index(True) == 6 and not any(won[7:11])


def test_connected_long_chain(spark):
    ids = [int(i) for i in np.random.default_rng(1).permutation(1000)]
    e = spark.createDataFrame([*zip(ids, ids[1:]), (2000, 2000)], "a long, b long")
    got = {r["node"]: r["component"] for r in cluster.connected(e).collect()}
    assert got == {i: 0 for i in ids} | {2000: 2000}


def test_connected_and_ratio_boundary(spark):
    from pointlake.operators.aggregates import ratio_having

    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 8)], "a long, b long")
    assert {r["node"]: r["component"] for r in cluster.connected(e).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 8, 9: 8}
    hit = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 1)], "vx long, vy long, vz long, hit long")
    cross = spark.createDataFrame([(0, 0, 0, 19), (1, 0, 0, 20)], "vx long, vy long, vz long, cross long")
    assert [r["vx"] for r in ratio_having(hit, cross).collect()] == [0]


def test_class_quotas():
    import numpy as np

    from pointlake.operators.windows import pick_suppressed

    value, classes = np.array([9.0, 8, 7, 6, 5, 4, 3]), ["a", "a", "a", "b", "b", "c", "a"]
    assert pick_suppressed(value, 0, 0, 0.1, np.ones(7, bool), classes, {"a": 2, "b": 1}) == [0, 1, 3]
    assert pick_suppressed(value, 0, 1, 0.1, np.ones(7, bool), classes, {"a": 2, "b": 1}) == [0, 2, 4]
    assert pick_suppressed(value, 3, 0, 0.1, np.ones(7, bool)) == [0, 1, 2]


def test_device_clock_in_any_zone(spark):
    from pyspark.sql import functions as F

    from pointlake.functions import nmea

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        at = lambda *v: nmea.device_seconds(*[F.lit(x) for x in v])
        row = spark.range(1).select(at(1970, 1, 2, 0, 0, 1, 500_000_000).alias("a"), at(2024, 2, 30, 0, 0, 0, 0).alias("b")).first()
        assert row["a"] == 86401.5 and row["b"] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_mixture_density(spark):
    import numpy as np

    from pointlake.operators import models

    weight, mean, var = np.array([0.3, 0.7]), np.array([[0.0, 1.0], [2.0, -1.0]]), np.array([[1.0, 0.5], [2.0, 0.25]])
    rows = [(0.0, 0.0), (1.5, -1.0), (40.0, 40.0)]
    got = spark.createDataFrame(rows, "x double, y double").select("x", models.mixture(["x", "y"], weight, mean, var).alias("g")).collect()
    for (x, y), r in zip(rows, got):
        logs = [np.log(w) - 0.5 * np.sum((np.array([x, y]) - m) ** 2 / v + np.log(2 * np.pi * v)) for w, m, v in zip(weight, mean, var)]
        assert abs(r["g"] - np.logaddexp(*logs)) < 1e-9
