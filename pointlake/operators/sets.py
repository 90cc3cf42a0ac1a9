"""Sorts, limits and set operations (O1-O8, U_1-U_7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_value(df: DataFrame, value: str, tie: str, descending: bool = False) -> DataFrame:
    """O1, O2: sorted, ties by position (the original sort isn't stable)."""
    return df.orderBy(F.desc(value) if descending else F.asc(value), tie)


def first_acceptable(df: DataFrame, key: list[str], visit: str, score: str, coarse: float = 0.35, fine: float = 0.5) -> DataFrame:
    """By visit order the first candidate below `coarse`; else the best below `fine`; else no row."""
    first = F.min(F.when(F.col(score) < coarse, F.struct(visit, score)))
    best = F.min(F.when(F.col(score) < fine, F.struct(score, visit)))
    c = df.groupBy(*key).agg(first.alias("f"), best.alias("b"))
    return c.select(*key, F.coalesce(f"f.{visit}", f"b.{visit}").alias(visit), F.coalesce(f"f.{score}", f"b.{score}").alias(score)).where(F.col(score).isNotNull())


def numeric_names(df: DataFrame, name: str) -> DataFrame:
    """By the number in front of a file name."""
    return df.orderBy(F.regexp_extract(name, r"(\d+)", 1).cast("long"), name)


def stride(df: DataFrame, order: list[str], key: list[str], n: int = 10) -> DataFrame:
    """Rows 0, n, 2n ... of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).where(F.col("_r") % n == 0).drop("_r")


def union(*frames: DataFrame) -> DataFrame:
    """U_1, U_5: all rows (merging unsorted lists is concatenation)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def history(df: DataFrame, k: Column | int, reach: int = 25, inclusive: bool = False, by: str = "id") -> DataFrame:
    """U_2 (Q23): rows k - reach .. k + reach, upper bound inclusive or not."""
    c = F.col(by)
    return df.where((c >= k - reach) & ((c <= k + reach) if inclusive else (c < k + reach)))


def less(df: DataFrame, gone: DataFrame, cells: list[str]) -> DataFrame:
    """U_3: voxels that weren't crossed."""
    return df.join(gone.select(*cells), cells, "left_anti")


def common(df: DataFrame, other: DataFrame, cells: list[str]) -> DataFrame:
    """U_4: voxels that were."""
    return df.join(other.select(*cells), cells, "left_semi")


def cache_difference(cache: DataFrame, new: DataFrame, on: str) -> DataFrame:
    """U_6: what to erase from a cache and what to add."""
    both = cache.select(on, F.lit(True).alias("_c")).join(new.select(on, F.lit(True).alias("_n")), on, "full_outer")
    return both.where(F.col("_c").isNull() | F.col("_n").isNull()).select(on, F.when(F.col("_c").isNull(), "add").otherwise("erase").alias("action"))
