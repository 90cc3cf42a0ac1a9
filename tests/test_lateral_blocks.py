"""Ranked loops by cells against the table of all candidates, which is not made any more."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pointlake.functions import descriptor
from pointlake.operators import joins, lateral
from pointlake.session import rounded

SHAPE = {"rings": 4, "sectors": 8, "reach": 20.0}


def test_pairs_of_laid_out_descriptors_are_the_same():
    r = np.random.default_rng(1)
    for rings, sectors, share in ((4, 8, 0.1), (5, 20, 0.3), (3, 6, 0.1)):
        d = r.normal(size=(40, rings, sectors)) * (r.random((40, rings, sectors)) < 0.4)
        d[3] = 0.0
        i, j = r.integers(0, 40, 300), r.integers(0, 40, 300)
        a = descriptor.laid_out(d)
        assert np.array_equal(descriptor.distances(d[i], d[j], share)[0], descriptor.pair_distances(a, i, a, j, share), equal_nan=True)


@pytest.mark.parametrize("older, newer", [(1 << 17, 1 << 14), (40, 25)])
def test_ranked_loops_without_a_table_of_candidates(spark, monkeypatch, older, newer):
    r = np.random.default_rng(5)
    at = np.vstack([r.normal(size=(110, 3)), r.normal(size=(20, 3)) * 4, np.repeat(r.normal(size=(1, 3)), 20, 0)])
    nodes = [(i, i, *map(float, p)) for i, p in enumerate(at)] + [(900, 900, None, 0.0, 0.0), (901, None, 0.0, 0.0, 0.0)]
    nodes = spark.createDataFrame(nodes, "id long, t long, x double, y double, z double")
    cloud = [(i, k, *map(float, p)) for i in range(150) if i % 37 != 5 for k, p in enumerate(r.normal(size=(21, 3)) * 5)]  # some nodes have no points
    points = spark.createDataFrame(cloud + [(i, 0, 500.0, 0.0, 1.0) for i in (5, 42)], "frame long, pos long, x double, y double, z double")
    distance = descriptor.distance(4, 8)
    near = joins.radius_join(nodes, nodes, 1.2).where("t - t_r >= 4").select("id", "id_r")
    scored = lateral.lateral_scores(near, points, distance, **SHAPE)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(rounded(F.col("score")).asc_nulls_last(), "id_r"))
    shown = lambda df: sorted(((x.id, x.id_r, x.score, x.shift, x.fine, x["rank"]) for x in df.select("id", "id_r", rounded(F.col("score")).alias("score"), rounded(F.col("shift"), 1).alias("shift"), "fine", "rank").collect()), key=str)
    want = shown(nodes.select("id").join(scored.withColumn("rank", rank), "id", "left"))
    monkeypatch.setattr(lateral, "lateral_scores", lambda *a, **k: pytest.fail("a table of candidates is made"))
    if hasattr(lateral, "OLDER"):
        monkeypatch.setattr(lateral, "OLDER", older)
        monkeypatch.setattr(lateral, "NEWER", newer)
    got = shown(lateral.ranked_loops(nodes, points, distance, 1.2, 4, digits=6, **SHAPE))
    assert got == want
    assert any(x[4] for x in want) and any(x[1] is None for x in want) and any(x[1] is not None and x[2] is None for x in want)
