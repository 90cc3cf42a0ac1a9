"""Aggregations: voxels, range images, polar descriptors, statistics, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.functions.geometry import ring_sector, voxel


def with_voxel(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({f"v{c}": voxel(F.col(c), size) for c in "xyz"})


def voxel_centroid(df: DataFrame, size: float, key: list[str]) -> DataFrame:
    """A1, U_7: centroid of each occupied voxel."""
    return with_voxel(df, size).groupBy(*key, "vx", "vy", "vz").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))


def voxel_centres(df: DataFrame, size: float, key: list[str]) -> DataFrame:
    """Geometric centres of the occupied voxels."""
    cells = with_voxel(df, size).select(*key, "vx", "vy", "vz").distinct()
    return cells.withColumns({c: (F.col(f"v{c}") + 0.5) * size for c in "xyz"})


def last_per_cell(df: DataFrame, cell: list[str], order: Column, value: str) -> DataFrame:
    """A3: of the rows of a cell the last in order wins."""
    return df.groupBy(*cell).agg(F.max_by(value, order).alias(value))


def nearest_per_cell(df: DataFrame, cell: list[str], depth: str) -> DataFrame:
    """A4."""
    return df.groupBy(*cell).agg(F.min(depth).alias(depth))


def polar_max(df: DataFrame, rings: int, sectors: int, reach: float, lift: float = 2.0, ceil: bool = True, near: float = 0.0, floor_at_zero: bool = False, cap: int | None = None) -> DataFrame:
    """Largest height + lift by polar bin within (near, reach]; only occupied bins are rows."""
    ring, sector = ring_sector(F.col("x"), F.col("y"), rings, sectors, reach, ceil)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    kept = df.where((r <= reach) & (r >= near)).withColumn("ring", ring).withColumn("sector", sector).withColumn("h", F.col("z") + lift)
    if cap:
        w = Window.partitionBy("frame", "ring", "sector").orderBy("pos")
        kept = kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    top = F.max("h")
    return kept.groupBy("frame", "ring", "sector").agg((F.greatest(top, F.lit(0.0)) if floor_at_zero else top).alias("h"))


def dense(bins: DataFrame, rings: int, sectors: int) -> DataFrame:
    """A descriptor array for each frame, 0 where a bin is empty: scatter into a map, no grid is joined."""
    cells = bins.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct(F.col("ring") * sectors + F.col("sector"), "h"))).alias("m"))
    return cells.select("frame", F.transform(F.sequence(F.lit(0), F.lit(rings * sectors - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("d"))


def ring_mean(bins: DataFrame, sectors: int) -> DataFrame:
    """A8 on sparse bins: the sum over a ring by the dense width."""
    return bins.groupBy("frame", "ring").agg((F.sum("h") / sectors).alias("ring_key"))


def ring_share(bins: DataFrame, sectors: int) -> DataFrame:
    """A9."""
    return bins.groupBy("frame", "ring").agg((F.count_if(F.col("h") != 0) / F.lit(float(sectors))).alias("occupancy"))


def sector_mean(bins: DataFrame, rings: int) -> DataFrame:
    """A10."""
    return bins.groupBy("frame", "sector").agg((F.sum("h") / rings).alias("sector_key"))


def hits(points: DataFrame, size: float) -> DataFrame:
    """A11."""
    return with_voxel(points, size).groupBy("vx", "vy", "vz").agg(F.count("*").alias("hit"))


def crosses(steps: DataFrame, hit: DataFrame) -> DataFrame:
    """Crossings of voxels that have hits; steps: a row for each voxel a ray walks."""
    return steps.join(hit.select("vx", "vy", "vz"), ["vx", "vy", "vz"], "left_semi").groupBy("vx", "vy", "vz").agg(F.count("*").alias("cross"))


def ratio_having(hit: DataFrame, cross: DataFrame, least: float = 0.05) -> DataFrame:
    """Voxels with hit / (hit + cross) of at least `least`."""
    both = hit.join(cross, ["vx", "vy", "vz"], "left").withColumn("cross", F.coalesce("cross", F.lit(0).cast("long")))
    return both.where(F.col("hit") >= (F.col("hit") + F.col("cross")) * least)


def bounds(df: DataFrame, key: list[str]) -> DataFrame:
    """Extremes, sums and sums of squares by axis."""
    return df.groupBy(*key).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], *[F.sum(c).alias(f"sum_{c}") for c in "xyz"], *[F.sum(F.col(c) * F.col(c)).alias(f"sq_{c}") for c in "xyz"])


def frequency(df: DataFrame, by: str, more_than: int = 0, top: int | None = None) -> DataFrame:
    """A16-A19 (Q1: true counts): groups of more than `more_than` rows, or the `top` largest, ties by key."""
    out = df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return out.orderBy(F.desc("n"), by).limit(top) if top else out


def azimuth_stats(df: DataFrame, value: str, max_var: float = 5.0, least: int = 30) -> DataFrame:
    """Mean and population variance by 1-degree azimuth, where the variance is small and rows are many."""
    deg = F.round(F.degrees(F.atan2("y", "x")) + 180).cast("int")
    return df.groupBy(deg.alias("deg")).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.count("*").alias("n")).where((F.col("var") <= max_var) & (F.col("n") >= least))


def nested(df: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Rows of a group as an array in order of the columns named."""
    return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("rows"))


def centroid(df: DataFrame, key: list[str]) -> DataFrame:
    """A22."""
    return df.groupBy(*key).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"], F.count("*").alias("n"))


def max_distance(df: DataFrame, key: list[str]) -> DataFrame:
    """Largest distance from the centroid."""
    both = df.join(centroid(df, key).drop("n"), key)
    d2 = sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return both.groupBy(*key).agg(F.sqrt(F.max(d2)).alias("reach"))


def neighbour_covariance(near: DataFrame) -> DataFrame:
    """Covariance of each row's neighbours (x_r, y_r, z_r of a knn result), six columns."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return near.groupBy("pos").agg(*[F.covar_pop(f"{a}_r", f"{b}_r").alias(f"c{a}{b}") for a, b in pairs], F.count("*").alias("n"))


def pca2d(df: DataFrame, key: list[str]) -> DataFrame:
    """Ascending eigenvalues of the 2-D sample covariance in closed form; zeros where it is singular."""
    s = df.groupBy(*key).agg(F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt((F.col("a") - F.col("b")) ** 2 / 4 + F.col("c") ** 2)
    ok = (F.col("a") * F.col("b") - F.col("c") ** 2) > 0
    return s.select(*key, F.when(ok, half - root).otherwise(0.0).alias("low"), F.when(ok, half + root).otherwise(0.0).alias("high"))


def confusion(judged: DataFrame, positive: Column, right: Column, exists: Column, key: list[str] = ()) -> DataFrame:
    """Counts, precision and recall. positive: a match was claimed; right: it is true; exists: there was one to
    find. All branches are total: every row is in exactly one of tp, fp, tn, fn (Q4)."""
    return judged.groupBy(*key).agg(
        F.count_if(positive & right).alias("tp"), F.count_if(positive & ~right).alias("fp"),
        F.count_if(~positive & exists).alias("fn"), F.count_if(~positive & ~exists).alias("tn"),
    ).withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))).withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))))


def auc(curve: DataFrame) -> DataFrame:
    """A33 (Q8): area under (recall, precision), end points (0, 1) and (1, 0) added, all-zero rows left out."""
    ends = curve.sparkSession.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "recall double, precision double")
    pts = curve.select("recall", "precision").where("recall > 0 OR precision > 0").unionByName(ends).distinct()
    w = Window.orderBy("recall", F.desc("precision"))  # a curve has a point for each threshold, not for each row
    step = (F.col("recall") - F.lag("recall").over(w)) * (F.col("precision") + F.lag("precision").over(w)) / 2
    return pts.select(step.alias("s")).agg(F.sum("s").alias("auc"))


def spread_error(poses: DataFrame, end: tuple, order: str = "pos") -> DataFrame:
    """A34 (Q37): the end error spread linearly over the rows of each key `frame`."""
    w = Window.partitionBy("frame").orderBy(order)
    last = Window.partitionBy("frame").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(last)
    return poses.select(*[c for c in poses.columns if c not in "xyz"], *[(F.col(c) - (F.last(c).over(last) - e) * F.row_number().over(w) / n).alias(c) for c, e in zip("xyz", end)])


def evicted(landmarks: DataFrame, now: float, old: float = 10.0, far: float = 80.0, share: float = 0.2) -> DataFrame:
    """Landmarks to keep: matched lately and near, and associated often enough."""
    return landmarks.where(~((~F.col("matched")) & ((F.lit(now) - F.col("seen") > old) | (F.col("dist") > far)) | (F.col("assoc") / F.greatest("visible", F.lit(1)) < share)))


def density(pairs: DataFrame, key: str = "id", by: float = 10.0) -> DataFrame:
    """Neighbours within a radius, over 10."""
    return pairs.groupBy(key).agg((F.count("*") / by).alias("density"))
