"""Distribution-to-distribution registration by class (G21, with A24's plane rule), for many pairs of clouds at once.

A point's neighbourhood counts as a small disc: its covariance has singular values (1, 1, eps), eps along the normal, so it is
I - (1 - eps) n n'. Each round moves the source points by their pair's pose, joins each with its nearest target point of the same class
within reach, and adds up the normal equations of the residual d = R p + t - q under the weight M = (C_q + R C_p R')^-1 / (1 + d'M d / c^2)
(Cauchy's loss) in batches and by an aggregate; a batch of 6 x 6 solves gives the next poses. All pairs go through a round together, rounds are stored, and
they end when no pose moves by more than `settle`, or after `rounds`. A pair of clouds of up to SMALL points each takes its rounds in one task instead: only
larger ones need a join and a plan for each round.

A point with fewer than three neighbours, or with neighbours on a line, has no normal and counts as a ball (C = I). A pair without matches, or
whose equations have no unique solution, keeps its pose in the directions that are open. Keys match by equality; null keys have no partner.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geometry import transformed
from pointlake.operators.joins import knn
from pointlake.operators.windows import POSE
from pointlake.session import stored

SMALL = 512
_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


def _normals(*parts: pd.Series) -> pd.DataFrame:
    n, c = parts[0].to_numpy(), np.zeros((len(parts[0]), 3, 3))
    for (a, b), v in zip(_PAIRS, parts[1:]):
        i, j = "xyz".index(a), "xyz".index(b)
        c[:, i, j] = c[:, j, i] = v.to_numpy(float)
    val, vec = np.linalg.eigh(np.nan_to_num(c))
    ok = (n >= 3) & (val[:, 1] > 1e-12 * np.maximum(val[:, 2], 1e-300))
    return pd.DataFrame(np.where(ok[:, None], vec[:, :, 0], 0.0), columns=["nx", "ny", "nz"])


def with_normals(points: DataFrame, key: list[str], k: int, reach: float) -> DataFrame:
    """Points (key, pos, x, y, z) with the unit normal nx, ny, nz of their k nearest neighbours (themselves included); zero without one."""
    near = knn(points, points, k, reach, key, other=False)
    cov = near.groupBy(*key, "pos").agg(F.count("*").alias("_n"), *[F.covar_pop(f"{a}_r", f"{b}_r").alias(f"_{a}{b}") for a, b in _PAIRS])
    udf = F.pandas_udf(_normals, "nx double, ny double, nz double")
    return points.join(cov.select(*key, "pos", udf("_n", *[f"_{a}{b}" for a, b in _PAIRS]).alias("_v")), [*key, "pos"]).select(*points.columns, "_v.*")


def _next(s: np.ndarray) -> np.ndarray:
    """Next poses and how far they moved from 21 + 6 sums and the 12 numbers of the pose; the step is a turn and a shift applied after the pose."""
    h, (i, j) = np.zeros((len(s), 6, 6)), np.triu_indices(6)
    h[:, i, j] = h[:, j, i] = s[:, :21]
    val, vec = np.linalg.eigh(np.nan_to_num(h))
    inner = np.einsum("nij,ni->nj", vec, np.nan_to_num(s[:, 21:27]))
    free = val > 1e-9 * np.maximum(val[:, -1:], 1e-300)
    step = -np.einsum("nij,nj->ni", vec, np.where(free, inner / np.where(free, val, 1.0), 0.0))
    w, angle = step[:, :3], np.linalg.norm(step[:, :3], axis=1)[:, None, None]
    cross = np.zeros((len(s), 3, 3))
    cross[:, [2, 0, 1], [1, 2, 0]], cross[:, [1, 2, 0], [2, 0, 1]] = w, -w
    safe = np.where(angle < 1e-12, 1.0, angle)
    turn = np.eye(3) + np.where(angle < 1e-12, 1.0, np.sin(safe) / safe) * cross + np.where(angle < 1e-12, 0.5, (1 - np.cos(safe)) / safe**2) * cross @ cross
    pose = turn @ s[:, 27:].reshape(-1, 3, 4)
    pose[:, :, 3] += step[:, 3:]
    return np.hstack([pose.reshape(-1, 12), np.abs(step).max(1, keepdims=True, initial=0)])


def _solved(*parts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_next(np.stack([p.to_numpy(float) for p in parts], 1)), columns=[*POSE, "moved"])


_SUMS = [*[f"h{a}{b}" for a in range(6) for b in range(a, 6)], *[f"g{a}" for a in range(6)], "n", "d2"]
_MATCH = ["mx", "my", "mz", "vx", "vy", "vz", "x_r", "y_r", "z_r", "nx_r", "ny_r", "nz_r"]


def _terms(m: np.ndarray, v: np.ndarray, q: np.ndarray, n: np.ndarray, eps: float, cauchy: float) -> np.ndarray:
    """What each match adds to _SUMS: moved points m and their normals v, their matches q with normals n."""
    i, j = np.triu_indices(6)
    a = 2 * np.eye(3) - (1 - eps) * (v[:, :, None] * v[:, None, :] + n[:, :, None] * n[:, None, :])
    with np.errstate(all="ignore"):
        adj = np.stack([np.cross(a[:, 1], a[:, 2]), np.cross(a[:, 2], a[:, 0]), np.cross(a[:, 0], a[:, 1])], 1)
        inv = adj / np.einsum("ni,ni->n", a[:, 0], adj[:, 0])[:, None, None]
    d = m - q
    e = np.einsum("nij,nj->ni", inv, d)
    w = 1 / (1 + np.einsum("ni,ni->n", e, d) / (cauchy * cauchy))
    # columns of the Jacobian: three turns (unit axis x moved point), three shifts
    jac = np.zeros((len(m), 3, 6))
    jac[:, :, 3:] = np.eye(3)
    jac[:, 1, 0], jac[:, 2, 0], jac[:, 0, 1], jac[:, 2, 1], jac[:, 0, 2], jac[:, 1, 2] = -m[:, 2], m[:, 1], m[:, 2], -m[:, 0], -m[:, 1], m[:, 0]
    turned = jac.transpose(0, 2, 1) * w[:, None, None]
    h, g = turned @ (inv @ jac), turned @ e[:, :, None]
    return np.column_stack([h[:, i, j], g[:, :, 0], np.ones(len(m)), (d * d).sum(1)])


def _equations(rows: DataFrame, key: list[str], eps: float, cauchy: float) -> DataFrame:
    """Sums of the normal equations of matched rows: moved point m*, its match x_r.., normals v* (moved) and nx_r.. of the match. Tasks add up
    their batches by key, an aggregate adds the batches."""

    def run(batches):
        for b in batches:
            terms = _terms(*(b[_MATCH[c : c + 3]].to_numpy(float) for c in (0, 3, 6, 9)), eps, cauchy)
            yield pd.concat([b[key].reset_index(drop=True), pd.DataFrame(terms, columns=_SUMS)], axis=1).groupby(key, as_index=False, sort=False).sum()

    types = dict(rows.dtypes)
    parts = rows.select(*key, *_MATCH).mapInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in key], *[f"{n} double" for n in _SUMS]]))
    of = parts.groupBy(*key).agg(*[F.sum(n).alias(n) for n in _SUMS])
    return of.select(*key, *_SUMS[:27], F.col("n").cast("long").alias("n"), (F.col("d2") / F.col("n")).alias("mse"))


def _gaps(a: np.ndarray, b: np.ndarray, same: np.ndarray, reach: float) -> np.ndarray:
    """Squared distances of all pairs, infinite beyond reach and where not `same`."""
    d2 = np.zeros(same.shape)
    for c in range(3):
        t = a[:, None, c] - b[None, :, c]
        d2 += t * t
    return np.where(same & (d2 <= reach * reach), d2, np.inf)


def _whole(source: DataFrame, target: DataFrame, key: list[str], label: str, k: int, reach: float, around: float, eps: float, cauchy: float, rounds: int, settle: float) -> DataFrame:
    """registered() of clouds of up to SMALL points: a pair goes through its rounds in one task."""

    def prepared(df: pd.DataFrame):
        df = df.sort_values("pos")  # of equal distances the first, so the smallest pos
        at, kind = df[list("xyz")].to_numpy(float), df[label].to_numpy()
        gap = _gaps(at, at, kind[:, None] == kind[None, :], around)
        near = np.argsort(gap, 1, kind="stable")[:, :k]
        ok = np.isfinite(np.take_along_axis(gap, near, 1))
        n = ok.sum(1)
        d = np.where(ok[:, :, None], at[near], 0.0)
        d = np.where(ok[:, :, None], d - (d.sum(1) / np.maximum(n, 1)[:, None])[:, None], 0.0)
        c = np.einsum("nki,nkj->nij", d, d) / np.maximum(n, 1)[:, None, None]
        normal = _normals(pd.Series(n), *[pd.Series(c[:, "xyz".index(i), "xyz".index(j)]) for i, j in _PAIRS])
        return at, kind, normal.to_numpy()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({c: [] for c in (*key, *POSE, "n", "mse")})
        (p, kp, vp), (q, kq, vq) = prepared(a), prepared(b.set_axis(a.columns, axis=1) if len(b) else a.iloc[:0])
        same, pose, n, mse = kp[:, None] == kq[None, :], np.eye(3, 4), 0, None
        for _ in range(rounds):
            m, v = p @ pose[:, :3].T + pose[:, 3], vp @ pose[:, :3].T
            gap = _gaps(m, q, same, reach)
            at = gap.argmin(1) if len(q) else np.zeros(len(p), int)
            ok = np.isfinite(gap[np.arange(len(p)), at]) if len(q) else np.zeros(len(p), bool)
            at = at[ok]
            sums = _terms(m[ok], v[ok], q[at], vq[at], eps, cauchy).sum(0)
            n, mse = int(sums[27]), sums[28] / sums[27] if sums[27] else None
            step = _next(np.concatenate([sums[:27], pose.ravel()])[None])[0]
            pose = step[:12].reshape(3, 4)
            if step[12] <= settle:
                break
        return pd.DataFrame([[*a[key].iloc[0], *pose.ravel(), n, mse]], columns=[*key, *POSE, "n", "mse"])

    types = dict(source.dtypes)
    form = ", ".join([*[f"{c} {types[c]}" for c in key], *[f"{c} double" for c in POSE], "n long", "mse double"])
    # names of its own: of two sides that share columns Spark drops some of the second
    other = target.select(*[F.col(c).alias(f"{c}_t") for c in source.columns])
    # dealt out by number: the points are few bytes and much work, tasks would be merged by size
    tasks = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = source.repartition(tasks, *key).groupBy(*key), other.repartition(tasks, *[f"{c}_t" for c in key]).groupBy(*[f"{c}_t" for c in key])
    return a.cogroup(b).applyInPandas(run, form)


def registered(source: DataFrame, target: DataFrame, key: list[str], label: str = "label", k: int = 20, reach: float = 5.0, around: float = 20.0, eps: float = 0.001, cauchy: float = 1.5, rounds: int = 35, settle: float = 1e-9, small: int = SMALL) -> DataFrame:
    """source, target (key, label, pos, x, y, z) -> (key, t00..t23, n, mse): the pose of every key of the source that takes it onto the target, the
    matches and mean square distance of its last round (0 and null without matches)."""
    by = [*key, label]
    real = " AND ".join([*[f"abs({c}) < double('infinity')" for c in "xyz"], *[f"{c} IS NOT NULL" for c in by]])
    source, target = (df.select(*by, "pos", "x", "y", "z").where(real) for df in (source, target))
    size = source.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(target.select(*key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    large = stored(size.where(F.greatest("a", "b") > small).select(*key))
    of = lambda how: [df.join(large, key, how) for df in (source, target)]
    if large.isEmpty():
        return _whole(source, target, key, label, k, reach, around, eps, cauchy, rounds, settle)
    whole = _whole(*of("left_anti"), key, label, k, reach, around, eps, cauchy, rounds, settle)
    source, target = (stored(with_normals(df, by, k, around)) for df in of("left_semi"))
    one = dict(zip(POSE, (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)))
    poses = source.select(*key).distinct().select(*key, *[F.lit(float(v)).alias(n) for n, v in one.items()], F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mse"))
    poses, next_pose = stored(poses), F.pandas_udf(_solved, ", ".join(f"{n} double" for n in [*POSE, "moved"]))
    for _ in range(rounds):
        t = [F.col(n) for n in POSE]
        held = source.join(poses.select(*key, *POSE), key)
        moved = dict(zip(("mx", "my", "mz"), transformed(F.col("x"), F.col("y"), F.col("z"), t)))
        turned = dict(zip(("vx", "vy", "vz"), transformed(F.col("nx"), F.col("ny"), F.col("nz"), [0.0 if i % 4 == 3 else v for i, v in enumerate(t)])))
        held = held.select(*by, "pos", *[v.alias(n) for n, v in (moved | turned).items()])
        near = knn(held.withColumns({c: F.col(f"m{c}") for c in "xyz"}), target, 1, reach, by, other=False)
        found = poses.select(*key, *POSE).join(_equations(near, key, eps, cauchy), key, "left")
        found = found.select(*key, next_pose(*[F.coalesce(F.col(s), F.lit(0.0)) for s in _SUMS[:27]], *POSE).alias("p"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mse").select(*key, "p.*", "n", "mse")
        found = stored(found)
        poses = found.drop("moved")
        if found.where(F.col("moved") > settle).isEmpty():
            break
    return whole.unionByName(poses)
