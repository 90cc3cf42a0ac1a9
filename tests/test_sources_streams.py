"""Files read back, and streams against their batch results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.sources import points as src
from pointlake.sources import tables
from pointlake.streaming import streams


def test_points_and_labels(spark, tmp_path):
    for i in range(3):
        np.arange(8, dtype="<f4").tofile(tmp_path / f"{i:06d}.bin")
        np.array([0x0012000A, 7], "<u4").tofile(tmp_path / f"{i:06d}.label")
    p, l = src.read_bin(spark, str(tmp_path)), src.read_label(spark, str(tmp_path))
    assert p.count() == 6 and l.where("pos = 0").select("label").distinct().first()[0] == 10
    assert src.read_bin(spark, str(tmp_path), low=1, high=2).select("frame_id").distinct().count() == 1
    assert src.paired(p, l).count() == 6
    mapped = src.remapped(l, spark.createDataFrame([(10, 3)], "raw long, mapped long"))
    assert sorted(r[0] for r in mapped.select("label").distinct().collect()) == [0, 3]
    np.zeros(5, "<f4").tofile(tmp_path / "000009.bin")
    assert src.read_bin(spark, str(tmp_path), strict=False).count() == 6
    with pytest.raises(Exception):
        src.read_bin(spark, str(tmp_path)).count()
    with pytest.raises(Exception):
        src.paired(p, l.where("pos = 0")).collect()
    out = tmp_path / "out"
    src.write_bin(src.read_bin(spark, str(tmp_path), strict=False), str(out))
    assert src.read_bin(spark, str(out)).count() == 6


def test_trajectories(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)], tables.TUM)
    tables.write_tum(df, str(tmp_path / "t"))
    assert tables.read_tum(spark, str(tmp_path / "t")).first() == df.first()
    (tmp_path / "k.txt").write_text("1 0 0 5 0 1 0 6 0 0 1 7\n1 0 0 8 0 1 0 9 0 0 1 10\n")
    k = tables.read_kitti(spark, str(tmp_path / "k.txt"))
    assert [(r["row"], r["t03"], r["t23"]) for r in k.orderBy("row").collect()] == [(0, 5.0, 7.0), (1, 8.0, 10.0)]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert tables.stage_cache(spark, str(tmp_path / "c"), make).count() == 3
    assert len(calls) == 1
    c = tables.class_list(spark, "labels:\n  10: car\n  11: tree\ninterest: 11")
    assert [(r["label"], r["wanted"]) for r in c.orderBy("label").collect()] == [(10, False), (11, True)]


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_stateful_streams(spark, tmp_path):
    rows = [(1, float(i), float(i), f"2024-01-01 00:00:{i:02d}") for i in range(6)]
    spark.createDataFrame(rows, "k long, t double, value double, s string").withColumn("ts", F.to_timestamp("s")).drop("s").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k long, t double, value double, ts timestamp").parquet(str(tmp_path / "in"))
    run(streams.gated(s, "k", 2.0), "gate")
    assert sorted(r["t"] for r in spark.table("gate").collect()) == [0.0, 2.0, 4.0]
    run(streams.last_n(s, "k", 3), "lastn")
    assert [r["frames"] for r in spark.table("lastn").orderBy("t").collect()][0] == [0.0, 1.0, 2.0]
    run(streams.warm(s, "k", 4), "warm")
    assert spark.table("warm").count() == 2
    run(streams.carried(s, "k", 0.5), "carried")
    assert {r["value"] for r in spark.table("carried").collect()} == {0.0}


def test_stream_join_equals_batch(spark, tmp_path):
    base = spark.range(20).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id"))).alias("ts"))
    base.coalesce(1).write.parquet(str(tmp_path / "a"))
    base.select(F.col("id").alias("rid"), F.col("ts").alias("ts_r")).coalesce(1).write.parquet(str(tmp_path / "b"))
    a = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "a"))
    b = spark.readStream.schema("rid long, ts_r timestamp").parquet(str(tmp_path / "b"))
    run(streams.interval_stream_join(a, b, 1.0, "5 seconds").select("id", "rid"), "sj")
    assert {(r["id"], r["rid"]) for r in spark.table("sj").collect()} == {(i, j) for i in range(20) for j in (i - 1, i) if j >= 0}
