"""Models and solvers (G15-G30, A26, A39, M21-M23). Sums over rows are Spark aggregates; the small systems they give
(6 x 6, k x d) are solved on the driver; per-key fits run as grouped maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kmeans(df: DataFrame, cols: list[str], start: np.ndarray, rounds: int = 50, eps: float = 1e-6) -> tuple[np.ndarray, float]:
    """Lloyd's rounds from given centres; stops when the cost changed by less than eps three times. One aggregate a round."""
    centres, last, calm, cost = np.asarray(start, float).copy(), None, 0, 0.0
    for _ in range(rounds):
        d2 = [sum(((F.col(c) - float(v)) ** 2 for c, v in zip(cols, row)), F.lit(0.0)) for row in centres]
        near = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("k")) for i, d in enumerate(d2)]))
        rows = df.select(*cols, near.alias("m")).groupBy("m.k").agg(*[F.avg(c).alias(c) for c in cols], F.sum("m.d").alias("cost")).collect()
        cost = sum(r["cost"] for r in rows)
        for r in rows:
            centres[r["k"]] = [r[c] for c in cols]
        calm = calm + 1 if last is not None and abs(last - cost) < eps * max(abs(last), 1e-12) else 0
        last = cost
        if calm >= 3:
            break
    return centres, cost


def nearest_centre(cols: list[str], centres: np.ndarray) -> Column:
    d2 = [sum(((F.col(c) - float(v)) ** 2 for c, v in zip(cols, row)), F.lit(0.0)) for row in centres]
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("k")) for i, d in enumerate(d2)]))["k"]


def gaussian(cols: list[str], mean, var) -> Column:
    """Log density of a diagonal normal."""
    out = F.lit(0.0)
    for c, m, v in zip(cols, mean, var):
        out = out - 0.5 * (np.log(2 * np.pi * v) + (F.col(c) - float(m)) ** 2 / float(v))
    return out


def gmm(df: DataFrame, cols: list[str], start: np.ndarray, rounds: int = 20, floor: float = 1e-3):
    """Diagonal-covariance EM from K-means centres: (weights, means, variances). One aggregate a round."""
    means, _ = kmeans(df, cols, start, 5)
    k = len(means)
    var, weight = np.ones_like(means), np.full(k, 1 / k)
    for _ in range(rounds):
        logs = [gaussian(cols, means[j], var[j]) + float(np.log(weight[j])) for j in range(k)]
        top = F.greatest(*logs) if k > 1 else logs[0]
        exps = [F.exp(g - top) for g in logs]
        total = sum(exps[1:], exps[0])
        r = df.select(*cols, *[(e / total).alias(f"_r{j}") for j, e in enumerate(exps)])
        s = r.agg(F.count("*").alias("n"), *[F.sum(f"_r{j}").alias(f"w{j}") for j in range(k)], *[F.sum(F.col(f"_r{j}") * F.col(c)).alias(f"s{j}_{i}") for j in range(k) for i, c in enumerate(cols)], *[F.sum(F.col(f"_r{j}") * F.col(c) ** 2).alias(f"q{j}_{i}") for j in range(k) for i, c in enumerate(cols)]).first()
        for j in range(k):
            w = max(s[f"w{j}"] or 0.0, 1e-12)
            weight[j] = w / max(s["n"], 1)
            means[j] = [(s[f"s{j}_{i}"] or 0.0) / w for i in range(len(cols))]
            var[j] = np.maximum([(s[f"q{j}_{i}"] or 0.0) / w - means[j][i] ** 2 for i in range(len(cols))], floor)
    return weight, means, var


def mixture(cols: list[str], weight: np.ndarray, means: np.ndarray, var: np.ndarray) -> Column:
    """Log density under all components, by their weights."""
    logs = [gaussian(cols, m, v) + float(np.log(max(w, 1e-300))) for w, m, v in zip(weight, means, var)]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    exps = [F.exp(g - top) for g in logs]
    return top + F.log(sum(exps[1:], exps[0]))


def viterbi(obs: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[list[int], float]:
    """The likeliest states of a sequence of symbols (log space), and exp(log probability / length)."""
    with np.errstate(divide="ignore"):
        ls, lm, le = np.log(start), np.log(move), np.log(emit)
    level, back = ls + le[:, obs[0]], []
    for o in obs[1:]:
        step = level[:, None] + lm
        back.append(step.argmax(0))
        level = step.max(0) + le[:, o]
    path = [int(level.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(np.exp(level.max() / len(obs)))


def decoded(df: DataFrame, key: list[str], order: list[str], symbol: str, start, move, emit, schema: str) -> DataFrame:
    """G18 for each sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        path, p = viterbi(pdf[symbol].to_numpy(int), np.asarray(start), np.asarray(move), np.asarray(emit))
        return pdf.assign(state=np.array(path, np.int32), likelihood=p)

    return df.groupBy(*key).applyInPandas(run, schema + ", state int, likelihood double")


def hmm_trained(df: DataFrame, key: list[str], order: list[str], symbol: str, states: int, symbols: int, schema: str, rounds: int = 5):
    """Segmental re-estimation: decode, count transitions and emissions with aggregates, repeat."""
    from pyspark.sql import Window

    rng = np.random.default_rng(0)
    start, move = np.full(states, 1 / states), np.full((states, states), 0.2 / max(states - 1, 1)) + np.eye(states) * (0.8 - 0.2 / max(states - 1, 1))
    emit = rng.dirichlet(np.ones(symbols), states)
    for _ in range(rounds):
        d = decoded(df, key, order, symbol, start, move, emit, schema)
        nxt = F.lead("state").over(Window.partitionBy(*key).orderBy(*order))
        d = d.withColumn("_next", nxt).groupBy("state", symbol, "_next").count().collect()
        m, e = np.full((states, states), 0.1), np.full((states, symbols), 0.1)
        for r in d:
            e[r["state"], r[symbol]] += r["count"]
            if r["_next"] is not None:
                m[r["state"], r["_next"]] += r["count"]
        move, emit = m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True)
    return start, move, emit


def kalman(df: DataFrame, key: list[str], order: list[str], schema: str, noise: dict, q: float = 0.1) -> DataFrame:
    """Position-velocity filter over (x, y) fixes at t with measurement noise by `status`; adds fx, fy, vx, vy."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        s, p, last, out = None, np.eye(4) * 10, None, []
        for t, x, y, status in zip(pdf["t"], pdf["x"], pdf["y"], pdf["status"]):
            z, r = np.array([x, y]), np.eye(2) * noise.get(status, 1.0)
            if s is None:
                s = np.array([x, y, 0.0, 0.0])
            else:
                a = np.eye(4)
                a[0, 2] = a[1, 3] = max(t - last, 0.0)
                s, p = a @ s, a @ p @ a.T + np.eye(4) * q
                g = p[:, :2] @ np.linalg.inv(p[:2, :2] + r)
                s, p = s + g @ (z - s[:2]), p - g @ p[:2, :]
            last = t
            out.append(s.copy())
        o = np.array(out)
        return pdf.assign(fx=o[:, 0], fy=o[:, 1], vx=o[:, 2], vy=o[:, 3])

    return df.groupBy(*key).applyInPandas(run, schema + ", fx double, fy double, vx double, vy double")


def normal_equations(df: DataFrame, jacobian: list[Column], residual: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """J'J, J'b and the squared error as one aggregate of 6*7/2 + 6 + 1 sums."""
    n, w = len(jacobian), weight if weight is not None else F.lit(1.0)
    rows = df.select(*[j.cast("double").alias(f"_j{i}") for i, j in enumerate(jacobian)], residual.alias("_b"), w.alias("_w"))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    s = rows.agg(*[F.sum(F.col("_w") * F.col(f"_j{i}") * F.col(f"_j{j}")).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(F.col("_w") * F.col(f"_j{i}") * F.col("_b")).alias(f"b{i}") for i in range(n)], F.sum(F.col("_w") * F.col("_b") ** 2).alias("e")).first()
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = s[f"a{i}_{j}"] or 0.0
    return a, np.array([s[f"b{i}"] or 0.0 for i in range(n)]), float(s["e"] or 0.0)


def damped_step(a: np.ndarray, b: np.ndarray, damping: float = 1e-6, weakest: float = 1e-9) -> np.ndarray:
    """One Levenberg step; directions whose eigenvalue is below `weakest` don't move."""
    val, vec = np.linalg.eigh(a + damping * np.eye(len(a)))
    return -vec @ np.where(val > weakest, (vec.T @ b) / np.where(val > weakest, val, 1), 0)


def icp(source: np.ndarray, target: np.ndarray, rounds: int = 100, reach: float = 100.0, eps: float = 1e-9):
    """Rigid alignment of two point sets: (R, t, mean squared distance), nearest neighbours by blocks."""
    r, t, last = np.eye(3), np.zeros(3), np.inf
    for _ in range(rounds):
        moved = source @ r.T + t
        near, d2 = np.zeros(len(moved), int), np.full(len(moved), np.inf)
        for at in range(0, len(moved), 1024):
            d = ((moved[at : at + 1024, None, :] - target[None, :, :]) ** 2).sum(2)
            near[at : at + 1024], d2[at : at + 1024] = d.argmin(1), d.min(1)
        ok = d2 <= reach**2
        if ok.sum() < 3:
            break
        r, t = aligned(source[ok], target[near[ok]])
        if abs(last - d2[ok].mean()) < eps:
            break
        last = d2[ok].mean()
    return r, t, last


def aligned(a: np.ndarray, b: np.ndarray):
    """The rotation and translation that take points a to b, pair by pair."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    r = vt.T @ d @ u.T
    return r, cb - r @ ca


def icp_pairs(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """G20 for rows (pair, source, target: arrays of x, y, z): one task for each batch of pairs."""

    def run(batches):
        for pdf in batches:
            out = []
            for _, p in pdf.iterrows():
                xyz = lambda v: np.array([[q["x"], q["y"], q["z"]] for q in v], float)
                r, t, e = icp(xyz(p["source"]), xyz(p["target"]), rounds)
                out.append([p["pair"], *np.hstack([r, t[:, None]]).ravel(), e])
            yield pd.DataFrame(out, columns=["pair", *[f"t{i}{j}" for i in range(3) for j in range(4)], "mse"])

    cols = ", ".join(f"t{i}{j} double" for i in range(3) for j in range(4))
    return pairs.mapInPandas(run, f"pair long, {cols}, mse double")


def pose_graph(n: int, edges: list[tuple], prior: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Planar poses (n x [x, y, yaw]) from relative edges (i, j, dx, dy, dyaw, weight), the first held at prior;
    Gauss-Newton on the driver, for graphs that fit there."""
    x = np.zeros((n, 3))
    x[0] = prior
    for i, j, dx, dy, da, _ in sorted((e for e in edges if e[1] == e[0] + 1), key=lambda e: e[0]):
        c, s = np.cos(x[i, 2]), np.sin(x[i, 2])
        x[j] = [x[i, 0] + c * dx - s * dy, x[i, 1] + s * dx + c * dy, x[i, 2] + da]
    for _ in range(rounds):
        h, g = np.eye(3 * n) * 1e-9, np.zeros(3 * n)
        h[:3, :3] += np.eye(3) * 1e6
        g[:3] += 1e6 * (x[0] - prior)
        for i, j, dx, dy, da, w in edges:
            c, s = np.cos(x[i, 2]), np.sin(x[i, 2])
            rt = np.array([[c, s], [-s, c]])
            d = x[j, :2] - x[i, :2]
            e = np.append(rt @ d - [dx, dy], (x[j, 2] - x[i, 2] - da + np.pi) % (2 * np.pi) - np.pi)
            a, b = np.zeros((3, 3)), np.zeros((3, 3))
            a[:2, :2], a[:2, 2], a[2, 2] = -rt, np.array([[-s, c], [-c, -s]]) @ d, -1
            b[:2, :2], b[2, 2] = rt, 1
            for p, q in ((i, a), (j, b)):
                g[3 * p : 3 * p + 3] += w * q.T @ e
                for p2, q2 in ((i, a), (j, b)):
                    h[3 * p : 3 * p + 3, 3 * p2 : 3 * p2 + 3] += w * q.T @ q2
        step = np.linalg.solve(h, -g).reshape(n, 3)
        x += step
        if np.abs(step).max() < 1e-10:
            break
    return x


def hulls(df: DataFrame, key: list[str]) -> DataFrame:
    """Convex hull (array of x, y) and its area for each cluster."""
    from pointlake.functions.polygon import area, hull

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy(float))
        row = {k: [pdf[k].iloc[0]] for k in key} | {"hull": [[{"x": p[0], "y": p[1]} for p in h]], "area": [area(h)]}
        return pd.DataFrame(row)

    types = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in key)
    return df.groupBy(*key).applyInPandas(run, f"{types}, hull array<struct<x: double, y: double>>, area double")


def normal_of(points: np.ndarray):
    """Unit normal of a plane, None where the points don't make one."""
    if len(points) < 3:
        return None
    val, vec = np.linalg.eigh(np.cov(points.T))
    if val[1] <= 0 or val[0] < -1e-9 or val[0] > 0.5 * val[1]:
        return None
    return vec[:, 0]


def line_of(points: np.ndarray):
    """M22 (Q38): (anchor at z = 0, unit direction) of the line of least squares."""
    c = points.mean(0)
    d = np.linalg.svd(points - c)[2][0]
    return (c - d * c[2] / d[2] if abs(d[2]) > 1e-9 else c), d


def cylinder_of(points: np.ndarray, rounds: int = 30):
    """(anchor, direction, radius) of a cylinder by Gauss-Newton on distances to the axis."""
    c, d = points.mean(0), line_of(points)[1]
    basis = np.linalg.svd(d[None, :])[2][1:]
    p, radius = np.zeros(4), float(np.linalg.norm(np.cross(points - c, d), axis=1).mean())

    def distance(q):
        axis = d + q[2] * basis[0] + q[3] * basis[1]
        axis = axis / np.linalg.norm(axis)
        return np.linalg.norm(np.cross(points - (c + q[0] * basis[0] + q[1] * basis[1]), axis), axis=1)

    for _ in range(rounds):
        base = distance(p)
        j = np.stack([*((distance(p + np.eye(4)[k] * 1e-6) - base) / 1e-6 for k in range(4)), -np.ones(len(points))], 1)
        step = np.linalg.lstsq(j, -(base - radius), rcond=None)[0]
        p, radius = p + step[:4], radius + step[4]
        if np.abs(step).max() < 1e-10:
            break
    axis = d + p[2] * basis[0] + p[3] * basis[1]
    return c + p[0] * basis[0] + p[1] * basis[1], axis / np.linalg.norm(axis), float(radius)


def mean_rotation(rotations: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Mean of rotations by repeated log and exp."""
    m = rotations[0]
    for _ in range(rounds):
        logs = []
        for r in rotations:
            d = m.T @ r
            a = np.arccos(np.clip((np.trace(d) - 1) / 2, -1, 1))
            logs.append(np.zeros(3) if a < 1e-12 else a / (2 * np.sin(a)) * np.array([d[2, 1] - d[1, 2], d[0, 2] - d[2, 0], d[1, 0] - d[0, 1]]))
        w = np.mean(logs, 0)
        a = np.linalg.norm(w)
        if a < 1e-12:
            break
        k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / a
        m = m @ (np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k)
    return m
