"""Point-frame files (S1-S13, S43-S45, S47): binaryFile scans decoded with numpy in Arrow batches."""

from __future__ import annotations

import io
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "frame_id long, pos int, x float, y float, z float, intensity float"


def _files(spark: SparkSession, path: str, glob: str, low: int | None, high: int | None) -> DataFrame:
    """Files with the number in their name as frame_id; S4: only frames of [low, high), before any file is read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    df = df.withColumn("frame_id", F.regexp_extract("path", r"(\d+)\.[A-Za-z]+$", 1).cast("long"))
    if low is not None:
        df = df.where(F.col("frame_id") >= low)
    if high is not None:
        df = df.where(F.col("frame_id") < high)
    return df.select("frame_id", "content")


def _decoded(df: DataFrame, schema: str, fn) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for frame, content in zip(pdf["frame_id"], pdf["content"]):
                yield fn(frame, content)

    return df.mapInPandas(run, schema)


def read_bin(spark: SparkSession, path: str, channels: int = 4, low: int | None = None, high: int | None = None, strict: bool = True) -> DataFrame:
    """Headerless float32 records; a file that isn't a whole number of records fails, or is empty if not strict."""

    def fn(frame, content):
        if len(content) % (4 * channels):
            if strict:
                raise ValueError(f"frame {frame}: {len(content)} bytes are no whole number of records")
            content = b""
        a = np.frombuffer(content, "<f4").reshape(-1, channels)
        return pd.DataFrame({"frame_id": frame, "pos": np.arange(len(a), dtype=np.int32), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2], "intensity": a[:, 3] if channels > 3 else np.float32(0)})

    return _decoded(_files(spark, path, "*.bin", low, high), POINTS, fn)


def read_label(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """uint32 by point; the class is the low 16 bits."""

    def fn(frame, content):
        a = np.frombuffer(content, "<u4").astype(np.int64)
        return pd.DataFrame({"frame_id": frame, "pos": np.arange(len(a), dtype=np.int32), "raw": a, "label": a & 0xFFFF})

    return _decoded(_files(spark, path, "*.label", low, high), "frame_id long, pos int, raw long, label long", fn)


def remapped(labels: DataFrame, table: DataFrame) -> DataFrame:
    """Classes through a (raw, mapped) table; classes it doesn't name become 0."""
    return labels.join(F.broadcast(table.select(F.col("raw").alias("label"), "mapped")), "label", "left").withColumn("label", F.coalesce("mapped", F.lit(0))).drop("mapped")


def paired(points: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Points with their labels by (frame, position); strict: an unpaired row on either side fails."""
    both = points.join(labels.select("frame_id", "pos", "label", F.lit(True).alias("_l")).withColumnRenamed("label", "_label"), ["frame_id", "pos"], "full_outer")
    bad = F.col("_l").isNull() | F.col("x").isNull()
    if strict:
        both = both.withColumn("label", F.when(bad, F.raise_error(F.lit("points and labels don't pair"))).otherwise(F.col("_label")).cast("long"))
    else:
        both = both.where(~bad).withColumn("label", F.col("_label"))
    return both.drop("_l", "_label")


def frame_clock(df: DataFrame, period: float = 0.1) -> DataFrame:
    """S5."""
    return df.withColumn("t", F.col("frame_id") * period)


def write_bin(df: DataFrame, path: str) -> None:
    """One file for each frame, written by the task that holds it; path is a folder that all executors share."""

    def run(batches):
        for pdf in batches:
            for frame, rows in pdf.groupby("frame_id"):
                rows = rows.sort_values("pos")
                os.makedirs(path, exist_ok=True)
                rows[["x", "y", "z", "intensity"]].to_numpy("<f4").tofile(f"{path}/{int(frame):06d}.bin")
                yield pd.DataFrame({"frame_id": [frame], "n": [len(rows)]})

    def whole(pdf):
        return next(iter(run([pdf])))

    df.groupBy("frame_id").applyInPandas(whole, "frame_id long, n long").write.format("noop").mode("overwrite").save()


def decode_scan(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An 8-bit scan image: rows 0-31 intensity, 32-95 range (two bytes), 96-97 azimuth (two bytes), rest int64 time."""
    image = np.ascontiguousarray(image)
    two = lambda rows: np.frombuffer(np.ascontiguousarray(rows.T).tobytes(), "<u2").reshape(image.shape[1], -1).T
    stamps = np.frombuffer(np.ascontiguousarray(image[98:106].T).tobytes(), "<i8") if image.shape[0] >= 106 else np.zeros(image.shape[1], np.int64)
    return image[:32], two(image[32:96]), two(image[96:98])[0], stamps


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """ASCII point files: header lines up to DATA, then numbers."""

    def fn(frame, content):
        lines = content.decode().split("\n")
        at = next(i for i, x in enumerate(lines) if x.startswith("DATA"))
        names = next(x for x in lines if x.startswith("FIELDS")).split()[1:]
        a = np.loadtxt(io.StringIO("\n".join(lines[at + 1 :])), ndmin=2, dtype=np.float32)
        col = lambda n: a[:, names.index(n)] if n in names and len(a) else np.zeros(len(a), np.float32)
        return pd.DataFrame({"frame_id": frame, "pos": np.arange(len(a), dtype=np.int32), **{c: col(c) for c in ("x", "y", "z", "intensity")}})

    return _decoded(_files(spark, path, "*.pcd", None, None), POINTS, fn)


def keyframed(points: DataFrame, near: float = 2.5) -> DataFrame:
    """Points of a keyframed cloud; those with squared range under `near` go (no stale slot stays)."""
    return points.where(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") >= near)


def random_obstacles(spark: SparkSession, n: int, extent: float = 20.0, height: float = 3.0, step: float = 0.2, seed: int = 0) -> DataFrame:
    """Columns of points at `step` resolution, from a fixed seed."""
    snap = lambda c: F.round(c / step) * step
    base = spark.range(n).select(F.col("id"), snap((F.rand(seed) - 0.5) * extent).alias("x"), snap((F.rand(seed + 1) - 0.5) * extent).alias("y"), F.rand(seed + 2).alias("_h"))
    return base.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_h") * height / step).cast("int")))).select("id", "x", "y", (F.col("k") * step).alias("z"))
