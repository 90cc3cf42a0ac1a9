"""Operators over ordered rows (W1-W26). What a window can express is one, running products are scans over blocks; what depends on earlier
picks runs in one Python pass for each key, which is the unit that the operator is sequential in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointlake.operators import scan


def ordered(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def curvature(df: DataFrame, value: str, key: list[str], order: list[str], half: int = 5) -> DataFrame:
    """(sum over +-half rows - (2 half + 1) * value) squared; rows nearer than `half` to an end go."""
    w = ordered(key, order)
    n = 2 * half + 1
    wide = w.rowsBetween(-half, half)
    d = F.sum(value).over(wide) - F.col(value) * n
    return df.withColumns({"_n": F.count("*").over(wide), "_d": d}).where(F.col("_n") == n).withColumn("curvature", F.col("_d") * F.col("_d")).drop("_n", "_d")


def curvature3(df: DataFrame, key: list[str], order: list[str], half: int = 5) -> DataFrame:
    """The same for x, y, z, squares added."""
    wide = ordered(key, order).rowsBetween(-half, half)
    total = F.lit(0.0)
    for c in "xyz":
        d = F.sum(c).over(wide) - F.col(c) * (2 * half + 1)
        total = total + d * d
    return df.withColumns({"_n": F.count("*").over(wide), "curvature": total}).where(F.col("_n") == 2 * half + 1).drop("_n")


def occlusion(df: DataFrame, value: str, column: str, key: list[str], order: list[str], jump: float = 0.3, gap: int = 10) -> DataFrame:
    """Rows that a range jump to their neighbour hides (six on the farther side), or that two jumps isolate."""
    w = ordered(key, order)
    nxt, prv = F.lead(value).over(w), F.lag(value).over(w)
    close = F.abs(F.lead(column).over(w) - F.col(column)) < gap
    flagged = df.withColumns({
        "_down": F.coalesce((close & (F.col(value) - nxt > jump)).cast("int"), F.lit(0)),
        "_up": F.coalesce((close & (nxt - F.col(value) > jump)).cast("int"), F.lit(0)),
        "_alone": F.coalesce(((F.abs(prv - F.col(value)) > 0.02 * F.col(value)) & (F.abs(nxt - F.col(value)) > 0.02 * F.col(value))).cast("int"), F.lit(0)),
    })
    left, right = F.max("_down").over(w.rowsBetween(0, 5)), F.max("_up").over(w.rowsBetween(-6, -1))
    return flagged.withColumn("masked", (left == 1) | (F.coalesce(right, F.lit(0)) == 1) | (F.col("_alone") == 1)).drop("_down", "_up", "_alone")


def top_k(df: DataFrame, by: str, k: int, key: list[str], tie: list[str], descending: bool = True) -> DataFrame:
    """W4 without suppression, O1, O3, O4: rank within each key, ties by `tie`."""
    w = Window.partitionBy(*key).orderBy(F.desc(by) if descending else F.asc(by), *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pick_suppressed(value: np.ndarray, quota: int, reach: int, least: float, free: np.ndarray, classes=None, quotas: dict | None = None) -> list[int]:
    """Greedy picks by descending value; each frees no row within `reach` of it any more. With `quotas` each class has its
    own count (none: 0) in place of `quota`; a row of a full class is passed over and suppresses nothing."""
    out, left = [], dict(quotas or {})
    for i in np.lexsort((np.arange(len(value)), -value)):
        if value[i] < least or (quotas is None and len(out) >= quota):
            break
        if free[i] and (quotas is None or left.get(classes[i], 0) > 0):
            if quotas is not None:
                left[classes[i]] -= 1
            out.append(int(i))
            free[max(0, i - reach) : i + reach + 1] = False
    return out


def features(df: DataFrame, schema: str, key: list[str], sectors: int = 6, sharp: int = 2, less: int = 20, flat: int = 4, least: float = 0.1, reach: int = 5, label: str | None = None, quota: dict | None = None) -> DataFrame:
    """Sharp, less sharp and flat rows of each key (frame, ring) with suppression of neighbours.

    df: key, pos, curvature and, for quotas by class, `label`. A ring of a frame is bounded by the sensor, so it fits
    one task. schema: that of df, to which `feature` (2 sharp, 1 less sharp, -1 flat, 0 none) is added.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        out, c = np.zeros(len(pdf), np.int32), pdf["curvature"].to_numpy(float)
        for part in np.array_split(np.arange(len(pdf)), sectors):
            if not len(part):
                continue
            free = np.ones(len(part), bool)
            own = None if quota is None else pdf[label].iloc[part].tolist()
            picks = pick_suppressed(c[part], less, reach, least, free, own, quota)
            out[part[picks]] = 1
            out[part[picks[:sharp]]] = 2
            free &= out[part] == 0
            out[part[pick_suppressed(-c[part], flat, reach, -least, free)]] = -1
        return pdf.assign(feature=out)

    return df.groupBy(*key).applyInPandas(run, schema + ", feature int")


def carry_forward(df: DataFrame, value: str, key: list[str], order: list[str], step: float, schema: str) -> DataFrame:
    """A value farther than `step` from the last accepted one is replaced by it (recursive on accepted values)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, last = pdf[value].to_numpy(float).copy(), None
        for i, v in enumerate(out):
            if last is not None and not abs(v - last) <= step:
                out[i] = last
            last = out[i]
        return pdf.assign(**{value: out})

    return df.groupBy(*key).applyInPandas(run, schema)


POSE = [f"t{i}{j}" for i in range(3) for j in range(4)]


def pose_product(df: DataFrame, key: list[str], order: list[str], left: bool = False, parts: int | None = None) -> DataFrame:
    """Running product of rigid transforms (columns t00..t23), as a scan over blocks; left: new factors on the left."""
    return scan.prefix_product(df, key, order, POSE, scan.RIGID, left, parts)


def strap_down(df: DataFrame, key: list[str], order: list[str], gravity: float = -9.8, parts: int | None = None) -> DataFrame:
    """Position, speed and attitude (px, py, pz, vx, vy, vz, qw, qx, qy, qz) after each row's dt, by its acceleration
    (ax, ay, az) and turn rate (gx, gy, gz), from rest. The attitude grows by the small-angle quaternion (1, g dt / 2), which
    is not normalised, and moves the acceleration of the next row. Attitudes are a running product (a scan over blocks), speed
    and position running sums."""
    dt, q = F.col("dt"), ["qw", "qx", "qy", "qz"]
    turn = df.withColumns({"qw": F.lit(1.0)} | {f"q{c}": F.col(f"g{c}") * dt / 2 for c in "xyz"})
    turned = scan.prefix_product(turn, key, order, q, scan.QUATERNION, parts=parts)
    w = ordered(key, order)
    held = turned.withColumns({f"_{c}": F.coalesce(F.lag(c).over(w), F.lit(float(c == "qw"))) for c in q})
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    u, acc = [F.col(f"_q{c}") for c in "xyz"], [F.col(f"a{c}") for c in "xyz"]
    t = [2 * v for v in cross(u, acc)]
    moved = held.withColumns({f"_a{c}": a + F.col("_qw") * s + k + (gravity if c == "z" else 0.0) for c, a, s, k in zip("xyz", acc, t, cross(u, t))})
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    moved = moved.withColumns({f"v{c}": F.sum(F.col(f"_a{c}") * dt).over(run) for c in "xyz"})
    moved = moved.withColumns({f"p{c}": F.sum((F.col(f"v{c}") - F.col(f"_a{c}") * dt / 2) * dt).over(run) for c in "xyz"})
    return moved.select(*df.columns, *[f"{k}{c}" for k in "pv" for c in "xyz"], *q)


def relative(df: DataFrame, key: list[str], order: list[str], previous_first: bool = False) -> DataFrame:
    """T_i T_{i-1}^-1, or W8 (Q16): T_{i-1} T_i^-1; the first row is itself. Columns t00..t23, column math only."""
    from pointlake.functions.geometry import composed, inverse

    names = [f"t{i}{j}" for i in range(3) for j in range(4)]
    w = ordered(key, order)
    held = df.withColumns({f"_{n}": F.lag(n).over(w) for n in names})
    now, before = [F.col(n) for n in names], [F.col(f"_{n}") for n in names]
    step = composed(before, inverse(now)) if previous_first else composed(now, inverse(before))
    return held.select(*[c for c in df.columns if c not in names], *[F.when(F.col("_t00").isNull(), F.col(n)).otherwise(s).alias(n) for n, s in zip(names, step)])


def differences(df: DataFrame, value: str, key: list[str], order: list[str]) -> DataFrame:
    """W7 for a translation: value less the one before; the first row is itself."""
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(ordered(key, order)), F.lit(0.0)))


def rebased(df: DataFrame, value: str, key: list[str], order: list[str], start: float = 0.0) -> DataFrame:
    """First value less start taken off all."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("rebased", F.col(value) - (F.first(value).over(w) - start))


def dead_reckoning(df: DataFrame, accel: str, t: str, key: list[str], order: list[str], gap: float) -> DataFrame:
    """Speed and shift by double running sums; a step of `gap` or more begins a new segment."""
    w = ordered(key, order)
    dt = F.col(t) - F.lag(t).over(w)
    cut = F.when(dt.isNull() | (dt >= gap), 1).otherwise(0)
    a = df.withColumn("_cut", cut).withColumn("_dt", dt)
    a = a.withColumn("segment", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = a.withColumn("_dt", F.when(F.col("_cut") == 1, F.lit(0.0)).otherwise(F.col("_dt")))
    run = ordered([*key, "segment"], order).rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("speed", F.sum(F.col(accel) * F.col("_dt")).over(run))
    before = F.coalesce(F.lag("speed").over(ordered([*key, "segment"], order)), F.lit(0.0))
    a = a.withColumn("_s", before * F.col("_dt") + F.col(accel) * F.col("_dt") * F.col("_dt") / 2)
    return a.withColumn("shift", F.sum("_s").over(run)).drop("_cut", "_dt", "_s")


def upsampled(df: DataFrame, step: float, key: list[str], order: list[str]) -> DataFrame:
    """W14 (Q7: translation is interpolated too): rows every `step` between keyed poses x, y, z, qx, qy, qz, qw at t."""
    from pointlake.functions.geometry import slerp

    w, cols = ordered(key, order), ["t", "x", "y", "z", "qx", "qy", "qz", "qw"]
    held = df.withColumns({f"_{c}": F.lead(c).over(w) for c in cols}).where("_t IS NOT NULL")
    n = F.ceil((F.col("_t") - F.col("t")) / step).cast("int")
    rows = held.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))).withColumn("_u", F.col("_i") * step / (F.col("_t") - F.col("t")))
    u = F.col("_u")
    q = slerp([F.col(c) for c in cols[4:]], [F.col(f"_{c}") for c in cols[4:]], u)
    return rows.select(*key, (F.col("t") + F.col("_i") * step).alias("t"), *[(F.col(c) + (F.col(f"_{c}") - F.col(c)) * u).alias(c) for c in "xyz"], *[v.alias(c) for v, c in zip(q, cols[4:])])


def scan_time(df: DataFrame, key: list[str], order: list[str], period: float = 0.1) -> DataFrame:
    """W13, first step: a point's time within its scan (rel_time), by the azimuth turned since the scan's first point as a share of the whole
    turn, which lies between half a turn and one and a half. Up to the first point that is past half a turn azimuths are unwrapped from the first
    point, after it from the last one; whether a point comes after it is a running maximum, so windows express the state."""
    pi = 3.141592653589793
    w, seen = ordered(key, order), ordered(key, order).rowsBetween(Window.unboundedPreceding, -1)
    every = ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = df.withColumn("_o", -F.atan2("y", "x"))
    a = a.withColumns({"_s": F.first("_o").over(every), "_e": F.last("_o").over(every) + 2 * pi})
    turn = F.col("_e") - F.col("_s")
    a = a.withColumn("_e", F.when(turn > 3 * pi, F.col("_e") - 2 * pi).when(turn < pi, F.col("_e") + 2 * pi).otherwise(F.col("_e")))
    o, s, e = F.col("_o"), F.col("_s"), F.col("_e")
    early = F.when(o < s - pi / 2, o + 2 * pi).when(o > s + pi * 1.5, o - 2 * pi).otherwise(o)
    on = o + 2 * pi
    late = F.when(on < e - pi * 1.5, on + 2 * pi).when(on > e + pi / 2, on - 2 * pi).otherwise(on)
    a = a.withColumn("_half", (early - s > pi).cast("int")).withColumn("_past", F.coalesce(F.max("_half").over(seen), F.lit(0)))
    out = a.withColumn("rel_time", (F.when(F.col("_past") == 1, late).otherwise(early) - s) / (e - s) * period)
    return out.select(*df.columns, "rel_time")


def interpolated(rows: DataFrame, states: DataFrame, key: list[str], cols: list[str], width: float, angles: tuple[str, ...] = ()) -> DataFrame:
    """W13, second step: rows (key, t, ...) with columns `cols` of states (key, t, ...) at their time: between the last state at or before a row and the
    first one after it, in proportion; before the first and after the last state that state itself; null without any. Columns in
    `angles` (radians) take the shorter way. Of states of one time one is used.

    A two-sided as-of join: rows meet the states of their slice of time (width seconds) and the nearest ones outside, which a window over
    slices, not over rows, hands on. So a key with very many rows is spread over its slices."""
    at = F.floor(F.col("t") / width)
    state = states.groupBy(*key, "t").agg(F.first(F.struct(F.col("t").alias("_t"), *[F.col(c).alias(f"_{c}") for c in cols])).alias("_s")).withColumn("_at", at)
    ends = state.groupBy(*key, "_at").agg(F.min_by("_s", "t").alias("_low"), F.max_by("_s", "t").alias("_high"))
    none = F.lit(None).cast(ends.schema["_low"].dataType)
    slices = ends.unionByName(rows.select(*key, at.alias("_at")).distinct().select("*", none.alias("_low"), none.alias("_high")))
    slices = slices.groupBy(*key, "_at").agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    w = ordered(key, ["_at"])
    slices = slices.select(*key, "_at", F.last("_high", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"), F.first("_low", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_to"))
    row = F.struct(*[F.col(c) for c in rows.columns])
    both = rows.select(*key, at.alias("_at"), "t", row.alias("_row"), F.lit(None).cast(ends.schema["_low"].dataType).alias("_s"), F.lit(1).alias("_kind"))
    both = both.unionByName(state.select(*key, "_at", "t", F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), "_s", F.lit(0).alias("_kind")))
    w = Window.partitionBy(*key, "_at").orderBy("t", "_kind")
    both = both.withColumns({"_a": F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first("_s", True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    found = both.where("_kind = 1").join(slices, [*key, "_at"]).select("_row.*", F.coalesce("_a", "_from").alias("_a"), F.coalesce("_b", "_to").alias("_b"))
    found = found.withColumn("_u", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), (F.col("t") - F.col("_a._t")) / (F.col("_b._t") - F.col("_a._t"))))

    def between(c: str) -> Column:
        a, b = F.col(f"_a._{c}"), F.col(f"_b._{c}")
        gap = b - a
        if c in angles:
            gap = gap - 6.283185307179586 * F.round(gap / 6.283185307179586)
        return F.when(F.col("_u").isNotNull(), a + gap * F.col("_u")).otherwise(F.coalesce(a, b)).alias(c)

    return found.select(*rows.columns, *[between(c) for c in cols])


def frame_window(df: DataFrame, order: list[str], key: list[str], half: int = 6, col: str = "frame") -> DataFrame:
    """W15, W16, T7 in batch: the 2 half + 1 frames around each row, once all are there."""
    w = ordered(key, order).rowsBetween(-half, half)
    return df.withColumn("frames", F.collect_list(col).over(w)).where(F.size("frames") == 2 * half + 1)


def majority(df: DataFrame, flag: Column, key: list[str], order: list[str], rows: int = 7, share: float = 0.7) -> DataFrame:
    """W17, stateless part: the current row is true and at least `share` of the last `rows` rows are."""
    w = ordered(key, order).rowsBetween(1 - rows, 0)
    seen = df.withColumn("_f", flag.cast("int"))
    return seen.withColumns({"_n": F.count("*").over(w), "_s": F.sum("_f").over(w)}).withColumn("voted", (F.col("_f") == 1) & (F.col("_n") == rows) & (F.col("_s") >= F.lit(share) * rows)).drop("_f", "_n", "_s")


def majority_reset(df: DataFrame, flag: str, key: list[str], order: list[str], schema: str, rows: int = 7, share: float = 0.7) -> DataFrame:
    """W17 with its reset: a vote that passes empties the queue to false."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queue: list[bool] = []
        out = []
        pdf = pdf.sort_values(order, kind="stable")
        for f in pdf[flag].astype(bool):
            queue = [*queue, f][-rows:]
            won = f and len(queue) == rows and sum(queue) >= share * rows
            out.append(won)
            if won:
                queue = [False] * rows
        return pdf.assign(voted=out)

    return df.groupBy(*key).applyInPandas(run, schema + ", voted boolean")


def sparsified(df: DataFrame, key: list[str], order: list[str], schema: str, keep) -> DataFrame:
    """Greedy choice of rows; keep(kept rows, row) -> bool, both numpy records in order.

    Each choice depends on all before, so a map (key) is one pass; maps are independent.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        rec, kept = pdf.to_records(index=False), []
        for i in range(len(rec)):
            if not kept or keep(rec[kept], rec[i]):
                kept.append(i)
        return pdf.iloc[kept]

    return df.groupBy(*key).applyInPandas(run, schema)


def away_from_kept(distance: float):
    """Farther than distance from every kept row."""
    return lambda kept, r: bool(np.min((kept["x"] - r["x"]) ** 2 + (kept["y"] - r["y"]) ** 2 + (kept["z"] - r["z"]) ** 2) > distance**2)


def away_from_last(distance: float):
    """Moved at least distance since the last kept row."""
    return lambda kept, r: bool((kept["x"][-1] - r["x"]) ** 2 + (kept["y"][-1] - r["y"]) ** 2 + (kept["z"][-1] - r["z"]) ** 2 >= distance**2)


def unlike_kept(threshold: float):
    """W18 (Q27): largest cosine similarity of `d` to kept rows below the threshold."""

    def keep(kept, r):
        a, b = np.stack(list(kept["d"])).astype(float), np.asarray(r["d"], float)
        n = np.linalg.norm(a, axis=1) * np.linalg.norm(b)
        return bool(np.max(np.where(n > 0, a @ b / np.where(n > 0, n, 1), 0)) < threshold)

    return keep


def unlike_last_and_new(distance: float, threshold: float):
    """Far from the last kept row, and no earlier kept row matches."""
    far, unlike = away_from_last(distance), unlike_kept(threshold)
    return lambda kept, r: far(kept, r) and (len(kept) < 2 or unlike(kept[:-1], r))


def fused(threshold: float, w_sc: float, w_dis: float, alpha: float, d_th: float, far: float = 6.0):
    """w_sc D_sc + w_dis exp(-alpha (D - D_th)^2), 1 beyond `far`, at least the threshold against all kept rows."""

    def keep(kept, r):
        a, b = np.stack(list(kept["d"])).astype(float), np.asarray(r["d"], float)
        n = np.linalg.norm(a, axis=1) * np.linalg.norm(b)
        d_sc = 1 - np.where(n > 0, a @ b / np.where(n > 0, n, 1), 0)
        d = np.sqrt((kept["x"] - r["x"]) ** 2 + (kept["y"] - r["y"]) ** 2 + (kept["z"] - r["z"]) ** 2)
        score = np.where(d > far, 1.0, w_sc * d_sc + w_dis * np.exp(-alpha * (d - d_th) ** 2))
        return bool((score >= threshold).all())

    return keep


def islands(df: DataFrame, state: Column, key: list[str], order: list[str]) -> DataFrame:
    """Number of the run of equal states that each row belongs to, from 1."""
    w = ordered(key, order)
    s = df.withColumn("_s", state)
    start = F.when(F.lag("_s").over(w).eqNullSafe(F.col("_s")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return s.withColumn("_new", start).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumnRenamed("_s", "state").drop("_new")
