"""Projections, filters and predicates over point rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.geometry import ring_sector


def square(*cols: str) -> Column:
    out = F.lit(0.0)
    for c in cols:
        out = out + F.col(c) * F.col(c)
    return out


def without_nan(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose coordinates are numbers (null and NaN go)."""
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def beyond(df: DataFrame, r: float) -> DataFrame:
    """Points at distance r or more."""
    return df.where(square("x", "y", "z") >= r * r)


def range_band(df: DataFrame, low: float, high: float) -> DataFrame:
    """Points within a distance band."""
    return df.where(F.sqrt(square("x", "y", "z")).between(low, high))


def every_nth(df: DataFrame, n: int = 5, pos: str = "pos") -> DataFrame:
    """A systematic sample by position."""
    return df.where(F.pmod(F.col(pos), F.lit(n)) == 0)


def below_height(df: DataFrame, h: float) -> DataFrame:
    """P5."""
    return df.where(F.col("z") <= h)


def without_origin(df: DataFrame) -> DataFrame:
    """All-zero points are fillers."""
    return df.where(~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)))


def of_classes(df: DataFrame, wanted: DataFrame, on: str = "label") -> DataFrame:
    """Rows of wanted classes; the class stays as grouping key."""
    return df.join(wanted.select(on).distinct(), on, "left_semi")


def of_classes_with_reach(df: DataFrame, wanted: DataFrame, on: str = "label") -> DataFrame:
    """P7, and the largest distance of each frame."""
    kept = of_classes(df, wanted, on)
    return kept.withColumn("reach", F.max(F.sqrt(square("x", "y", "z"))).over(Window.partitionBy("frame")))


def in_box(df: DataFrame, centre: tuple, size: tuple, yaw: float) -> DataFrame:
    """P10: points inside an oriented box."""
    dx, dy, dz = (F.col(c) - v for c, v in zip("xyz", centre))
    c, s = F.cos(F.lit(yaw)), F.sin(F.lit(yaw))
    u, v = dx * c + dy * s, dy * c - dx * s
    return df.where((F.abs(u) <= size[0] / 2) & (F.abs(v) <= size[1] / 2) & (F.abs(dz) <= size[2] / 2))


def ground_cut_swapped(df: DataFrame, h: float = 0.6) -> DataFrame:
    """Points up to h, axes (x, y, z) -> (x, -z, y)."""
    others = [c for c in df.columns if c not in "xyz"]
    return df.where(F.col("z") <= h).select(*others, "x", (-F.col("z")).alias("y"), F.col("y").alias("z"))


def last_valid(df: DataFrame, value: str, order: list[str], key: list[str], valid: Column | None = None) -> DataFrame:
    """P12, stateless part: a value that isn't valid (where no condition is given: 0) is replaced by the last valid one."""
    valid = F.col(value) != 0 if valid is None else valid
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(F.when(valid, F.col(value)), ignorenulls=True).over(w))


def grid_stride(df: DataFrame, rings: int, sectors: int, reach: float, step: int) -> DataFrame:
    """Every step-th column of the polar grid."""
    _, sector = ring_sector(F.col("x"), F.col("y"), rings, sectors, reach)
    return df.withColumn("sector", sector).where(F.col("sector") % step == 0)


def parallel_match(dx: Column, dy: Column, pitch: Column, near: float = 0.5, tilt: float = 20.0) -> Column:
    """P14."""
    return (F.sqrt(dx * dx + dy * dy) < near) & (F.abs(pitch) < tilt)


def permuted(df: DataFrame) -> DataFrame:
    """(x, y, z) -> (y, z, x)."""
    others = [c for c in df.columns if c not in "xyz"]
    return df.select(*others, F.col("y").alias("x"), F.col("z").alias("y"), F.col("x").alias("z"))


def two_band_leaf(near: float = 20.0, far: float = 150.0, fine: float = 0.05, coarse: float = 0.2) -> Column:
    """Leaf size by range; null beyond `far`."""
    r = F.sqrt(square("x", "y", "z"))
    return F.when(r < near, fine).when(r <= far, coarse)
