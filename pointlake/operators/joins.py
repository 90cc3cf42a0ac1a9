"""Time, spatial and set joins (J1-J37). Ranges become equi-joins on buckets plus a residual filter; nothing is crossed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.operators import blocks
from pointlake.operators.reach import older_within


def nearest_time(left: DataFrame, right: DataFrame, tolerance: float, key: list[str] = (), once: bool = False, strict: bool = True) -> DataFrame:
    """Each left row (id, t) with its nearest right row (rid, rt) within tolerance; ties: smaller rid.

    Time is cut into buckets as wide as the tolerance; right rows are listed in their bucket and both neighbours. once:
    a right row goes to the first left row (by t, id) that takes it (J2).
    """
    width = tolerance if tolerance > 0 else 1.0
    a = left.withColumn("_b", F.floor(F.col("t") / width))
    b = right.withColumn("_b", F.explode(F.array(*[F.floor(F.col("rt") / width) + d for d in (-1, 0, 1)])))
    gap = F.abs(F.col("t") - F.col("rt"))
    near = a.join(b, ["_b", *key]).where(gap < tolerance if strict else gap <= tolerance)
    by = [c for c in left.columns if c in ("id", *key)]
    best = near.groupBy(*by, "t").agg(F.min(F.struct(gap.alias("gap"), "rid", "rt")).alias("m"))
    out = best.select(*by, "t", F.col("m.rid").alias("rid"), F.col("m.rt").alias("rt"), F.col("m.gap").alias("gap"))
    if once:
        first = out.groupBy("rid").agg(F.min(F.struct("t", "id")).alias("_f"))
        out = out.join(first, "rid").where((F.col("t") == F.col("_f.t")) & (F.col("id") == F.col("_f.id"))).drop("_f")
    return out


def interval_join(left: DataFrame, right: DataFrame, low: float, high: float, key: list[str] = ()) -> DataFrame:
    """Left (id, t) with right (rid, rt) where rt - t lies in [low, high)."""
    width = max(high - low, 1e-9)
    a = left.withColumn("_b", F.explode(F.array(*[F.floor((F.col("t") + low) / width) + d for d in (0, 1)])))
    b = right.withColumn("_b", F.floor(F.col("rt") / width))
    return a.join(b, ["_b", *key]).where((F.col("rt") - F.col("t") >= low) & (F.col("rt") - F.col("t") < high)).drop("_b")


def range_slice(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with t strictly inside (min, max) of the bounds' t; the bounds are one row."""
    lim = bounds.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    return rows.join(F.broadcast(lim), (F.col("t") > F.col("_lo")) & (F.col("t") < F.col("_hi"))).drop("_lo", "_hi")


def _cells(df: DataFrame, size: float, cols: tuple[str, ...], around: bool) -> DataFrame:
    for i, c in enumerate(cols):
        cell = F.floor(F.col(c) / size)
        df = df.withColumn(f"_c{i}", F.explode(F.array(cell - 1, cell, cell + 1)) if around else cell)
    return df


def radius_join(left: DataFrame, right: DataFrame, r: float, key: list[str] = (), suffix: str = "_r", cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Pairs within distance r, by cells of size r; right columns get a suffix, d2 is added."""
    b = right.select(*[F.col(c).alias(c if c in key else f"{c}{suffix}") for c in right.columns])
    a = _cells(left, r, cols, False)
    b = _cells(b, r, tuple(f"{c}{suffix}" for c in cols), True)
    d2 = F.lit(0.0)
    for c in cols:
        d2 = d2 + (F.col(c) - F.col(f"{c}{suffix}")) * (F.col(c) - F.col(f"{c}{suffix}"))
    cells = [f"_c{i}" for i in range(len(cols))]
    return a.join(b, [*cells, *key]).withColumn("d2", d2).where(F.col("d2") <= r * r).drop(*cells)


def knn(left: DataFrame, right: DataFrame, k: int, r: float, key: list[str] = (), other: bool = True) -> DataFrame:
    """The k nearest right rows within r of each left row (pos), ranked by (d2, pos_r)."""
    near = radius_join(left, right, r, list(key))
    if other:
        near = near.where("pos <> pos_r")
    w = Window.partitionBy("pos", *key).orderBy("d2", "pos_r")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_gated(left: DataFrame, right: DataFrame, k: int, gate: float, key: list[str] = ()) -> DataFrame:
    """K neighbours only where the k-th lies within the gate (squared distance)."""
    near = knn(left, right, k, gate**0.5, key)
    return near.groupBy("pos", *key).agg(F.count("*").alias("n"), F.max("d2").alias("worst")).where((F.col("n") == k) & (F.col("worst") < gate))


def ring_constrained(near: DataFrame, rings: float = 2.5) -> DataFrame:
    """To the nearest neighbour the nearest one on another ring within reach. near: pos, ring, pos_r, ring_r, d2."""
    first = near.groupBy("pos").agg(F.min(F.struct("d2", "pos_r", "ring_r")).alias("f"))
    rest = near.join(first, "pos").where((F.col("ring_r") != F.col("f.ring_r")) & (F.abs(F.col("ring_r") - F.col("f.ring_r")) <= rings))
    return rest.groupBy("pos").agg(F.first("f.pos_r").alias("first"), F.min(F.struct("d2", "pos_r")).alias("s")).select("pos", "first", F.col("s.pos_r").alias("second"))


def loop_candidates(nodes: DataFrame, r: float, age: float, cols: tuple[str, ...] = ("x", "y", "z"), key: list[str] = (), digits: int | None = None) -> DataFrame:
    """Earlier nodes within r that are at least `age` older (key, id, id_r, d2)."""
    return older_within(nodes, r, age, cols, key, digits)


def loop_first(nodes: DataFrame, r: float, age: float, cols: tuple[str, ...] = ("x", "y", "z"), key: list[str] = ()) -> DataFrame:
    """Of those the nearest, ties by id."""
    return loop_candidates(nodes, r, age, cols, key).groupBy("id", *key).agg(F.min(F.struct("d2", "id_r")).alias("m")).select("id", *key, F.col("m.id_r").alias("id_r"), F.col("m.d2").alias("d2"))


def upper_triangle(df: DataFrame, score, blocks: int = 8, key: str = "id", on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs i < j (with equal `on` columns) with a score, dealt out as block pairs by an equi-join."""
    part = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = df.select(*on, *[F.col(c).alias(f"{c}_a") for c in df.columns], part.alias("_p"), every.alias("_q"))
    b = df.select(*on, *[F.col(c).alias(f"{c}_b") for c in df.columns], part.alias("_q"), every.alias("_p"))
    return a.join(b, [*on, "_p", "_q"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(F.col(f"{key}_a").alias("i"), F.col(f"{key}_b").alias("j"), score.alias("sim"))


def rectangle(left: DataFrame, right: DataFrame, score, blocks: int = 8, key: str = "id") -> DataFrame:
    """Every left row with every right row and a score. Right rows are dealt out to blocks, left rows (the smaller
    set) to all of them by an equi-join; nothing is broadcast."""
    part = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    a = left.select(*[F.col(c).alias(f"{c}_a") for c in left.columns], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_p"))
    b = right.select(*[F.col(c).alias(f"{c}_b") for c in right.columns], part.alias("_p"))
    return a.join(b, "_p").select(F.col(f"{key}_a").alias("i"), F.col(f"{key}_b").alias("j"), score.alias("sim"))


def older_nearest(queries: DataFrame, rows: DataFrame, k: int = 10, newest: int = 50) -> DataFrame:
    """J18, search: of each query (id, key, d) the k rows nearest by the whole key array, without the `newest` rows before it;
    ties by id. Blocks of rows meet in tasks, which keep k of each query before the k of all blocks are picked; a gap that is none comes last."""
    width = max(1, rows.agg(F.max(F.size("key"))).first()[0] or 1)

    def pick(a, b, older):
        gap = np.zeros(older.shape)
        for c in range(width):
            t = a[:, None, c] - b[None, :, c]
            gap += t * t
        x, y = blocks.smallest(np.where(older, np.where(np.isnan(gap), np.finfo(float).max, gap), np.inf), k)
        return x, y, [gap[x, y]]

    q, r = (df.select("id", F.col("key").alias("d")) for df in (queries, rows))
    near = blocks.picked(q, r, width, pick, {"gap": "double"}, newest).withColumnsRenamed({"i": "id", "j": "id_r"})
    found = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("gap", "id_r"))).where(F.col("rank") <= k)
    return found.join(queries.select("id", "d"), "id").join(rows.select(F.col("id").alias("id_r"), F.col("d").alias("d_r")), "id_r")


def loop_by_descriptor(found: DataFrame, distance, accept: float = 0.5) -> DataFrame:
    """J18, rerank: the candidate of the smallest exact distance; its id only where that is below `accept`, else null."""
    m = found.withColumn("_m", distance("d", "d_r")).where(F.col("_m.dist").isNotNull() & ~F.isnan("_m.dist"))
    best = m.groupBy("id").agg(F.min(F.struct(F.col("_m.dist").alias("dist"), "rank", "id_r", F.col("_m.shift").alias("shift"))).alias("b"))
    return best.select("id", F.when(F.col("b.dist") < accept, F.col("b.id_r")).alias("loop"), F.col("b.dist").alias("dist"), F.col("b.shift").alias("shift"))


def cached(pairs: DataFrame, cache: DataFrame, compute: Column) -> DataFrame:
    """The cached score of a pair where there is one, else the computed one."""
    return pairs.join(cache.withColumnRenamed("score", "_s"), ["src", "dst"], "left").withColumn("score", F.coalesce("_s", compute)).drop("_s")


def unassigned(rows: DataFrame, matched: DataFrame, on: str = "id") -> DataFrame:
    """J26."""
    return rows.join(matched.select(on), on, "left_anti")


def matched_and_updated(rows: DataFrame, matched: DataFrame, on: str = "id", flag: str = "updated") -> DataFrame:
    """J27."""
    return rows.join(matched.select(on), on, "left_semi").where(F.col(flag))


def new_voxels(points: DataFrame, taken: DataFrame, cells: list[str]) -> DataFrame:
    """J30 (Q6: the evident intent): points whose voxel isn't taken."""
    return points.join(taken.select(*cells).distinct(), cells, "left_anti")


def positional(left: DataFrame, right: DataFrame, order_l: list[str], order_r: list[str], key: list[str]) -> DataFrame:
    """Rows zipped by number within a key; surplus is ignored."""
    n = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*o)))
    return n(left, order_l).join(n(right, order_r), [*key, "_n"]).drop("_n")


def neighbourhood(centres: DataFrame, voxels: DataFrame, reach: int) -> DataFrame:
    """Voxels (vx, vy, vz) within `reach` cells of each centre's voxel, by enumerated keys."""
    side = F.sequence(F.lit(-reach), F.lit(reach))
    around = centres
    for c in ("vx", "vy", "vz"):
        around = around.withColumn("_d", F.explode(side)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    return around.join(voxels, ["vx", "vy", "vz"])


def updated(rows: DataFrame, fresh: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """Columns overwritten by id where a fresh row exists."""
    new = fresh.select(on, *[F.col(c).alias(f"_{c}") for c in cols])
    kept = [c for c in rows.columns if c not in cols]
    return rows.join(new, on, "left").select(*kept, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def associated(new: DataFrame, old: DataFrame, r: float, tilt: float = 0.35, radius_gap: float = 0.2) -> DataFrame:
    """Each new landmark with the nearest known one of like radius and direction (unit ux, uy, uz; Q34); null: new."""
    near = radius_join(new, old, r, cols=("x", "y")).where(F.abs(F.col("radius") - F.col("radius_r")) <= radius_gap * F.greatest("radius", "radius_r"))
    cos = F.col("ux") * F.col("ux_r") + F.col("uy") * F.col("uy_r") + F.col("uz") * F.col("uz_r")
    best = near.where(F.acos(F.least(F.abs(cos), F.lit(1.0))) <= tilt).groupBy("id").agg(F.min(F.struct("d2", "id_r")).alias("m"))
    return new.join(best, "id", "left").select(*new.columns, F.col("m.id_r").alias("landmark"))
