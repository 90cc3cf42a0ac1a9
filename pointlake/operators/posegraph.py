"""Pose graphs in six dimensions over tables (G24, G25): Gauss-Newton steps by conjugate gradients, every product a join and a sum.

nodes (graph, id, t00..t23): poses to start from. factors (graph, i, j, z00..z23, wt, wr): the pose of j seen from i, with weights of its shift
and its turn; a null i means the world, so such a factor is a prior, and with wr = 0 a position fix. A factor's residual is the shift and the
turn (as a rotation vector) that are left, both in the measured frame; Jacobians are exact. A step is a shift in the node's frame and a turn after it.

Nothing of a graph is collected: linearised factors, the 6 x 6 blocks that precondition, and the vectors of the solver are tables, stored once
for each iteration; each graph has its own step lengths, which come back by a join. The driver sees one number for each iteration: the
largest residual left. Graphs are independent and go through the iterations together; small ones are solved whole, a graph in a task.

Factors with a node that isn't in `nodes` are left out, and so are those with a null j. Nodes without factors keep their pose, as do the directions in
which nothing holds a node (their blocks are solved by pseudo-inverse). Repeated factors count each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.operators.windows import POSE
from pointlake.session import stored

MEASURED = [f"z{n[1:]}" for n in POSE]


def cross(w: np.ndarray) -> np.ndarray:
    out = np.zeros((len(w), 3, 3))
    out[:, [2, 0, 1], [1, 2, 0]], out[:, [1, 2, 0], [2, 0, 1]] = w, -w
    return out


def rotation_vector(r: np.ndarray) -> np.ndarray:
    """Turns (n x 3 x 3) as axis times angle in [0, pi]."""
    v = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], 1) / 2
    s, c = np.linalg.norm(v, axis=1), (np.trace(r, axis1=1, axis2=2) - 1) / 2
    angle = np.arctan2(s, c)
    out = v * np.where(s > 1e-12, angle / np.where(s > 1e-12, s, 1), 1.0)[:, None]
    for k in np.flatnonzero((s <= 1e-6) & (c < 0)):  # near half a turn the axis is that of (r + r') / 2 + I
        axis = np.linalg.svd((r[k] + r[k].T) / 2 + np.eye(3))[0][:, 0]
        out[k] = axis * angle[k] * (-1.0 if axis @ v[k] < 0 else 1.0)
    return out


def turns(w: np.ndarray) -> np.ndarray:
    """Rotation vectors as matrices."""
    a = np.linalg.norm(w, axis=1)[:, None, None]
    k, small = cross(w), a < 1e-9
    safe = np.where(small, 1.0, a)
    return np.eye(3) + np.where(small, 1.0, np.sin(safe) / safe) * k + np.where(small, 0.5, (1 - np.cos(safe)) / safe**2) * k @ k


def linearised(ti: np.ndarray, tj: np.ndarray, z: np.ndarray, wt: np.ndarray, wr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Jacobian by i, by j, residual) of factors, n x 3 x 4 each, times the roots of the weights."""
    ri, rj, rz = ti[:, :, :3], tj[:, :, :3], z[:, :, :3]
    back = lambda m: m.transpose(0, 2, 1)
    d = np.einsum("nji,nj->ni", ri, tj[:, :, 3] - ti[:, :, 3])
    between = back(ri) @ rj
    turn = rotation_vector(back(rz) @ between)
    res = np.hstack([np.einsum("nji,nj->ni", rz, d - z[:, :, 3]), turn])
    a = np.linalg.norm(turn, axis=1)[:, None, None]
    small, k = a < 1e-5, cross(turn)
    safe = np.where(small, 1.0, a)
    inverse = np.eye(3) + k / 2 + np.where(small, 1 / 12, 1 / safe**2 - (1 + np.cos(safe)) / (2 * safe * np.where(np.sin(safe) == 0, 1e-12, np.sin(safe)))) * k @ k
    ji, jj = np.zeros((2, len(z), 6, 6))
    ji[:, :3, :3], ji[:, :3, 3:], ji[:, 3:, 3:] = -back(rz), back(rz) @ cross(d), -inverse @ back(between)
    jj[:, :3, :3], jj[:, 3:, 3:] = back(rz) @ between, inverse
    w = np.sqrt(np.hstack([np.repeat(wt[:, None], 3, 1), np.repeat(wr[:, None], 3, 1)]))
    return ji * w[:, :, None], jj * w[:, :, None], res * w


def _matrix(parts) -> np.ndarray:
    return np.stack([p.to_numpy(float) for p in parts], 1).reshape(-1, 3, 4)


def _linear(*parts: pd.Series) -> pd.DataFrame:
    ti, tj, z = (_matrix(parts[12 * k : 12 * k + 12]) for k in range(3))
    world = np.isnan(ti[:, 0, 0])
    ti[world] = np.eye(3, 4)
    ji, jj, res = linearised(ti, tj, z, parts[36].to_numpy(float), parts[37].to_numpy(float))
    ji[world] = 0
    return pd.DataFrame({"ji": list(ji.reshape(-1, 36)), "jj": list(jj.reshape(-1, 36)), "res": list(res)})


def _stacked(s: pd.Series, *shape: int) -> np.ndarray:
    return np.stack(s.to_numpy()).reshape(-1, *shape) if len(s) else np.zeros((0, *shape))


def _starts(ji: pd.Series, jj: pd.Series, res: pd.Series) -> pd.DataFrame:
    """A factor's part of the gradient and of its nodes' own blocks."""
    r, out = _stacked(res, 6), {}
    for name, j in (("i", _stacked(ji, 6, 6)), ("j", _stacked(jj, 6, 6))):
        out[f"g{name}"] = list(np.einsum("nab,na->nb", j, r))
        out[f"b{name}"] = list((j.transpose(0, 2, 1) @ j).reshape(-1, 36))
    return pd.DataFrame(out)


def _inverses(b: pd.Series) -> pd.Series:
    return pd.Series(list(np.linalg.pinv(_stacked(b, 6, 6), rcond=1e-10, hermitian=True).reshape(-1, 36)))


def _products(ji: pd.Series, jj: pd.Series, pi: pd.Series, pj: pd.Series) -> pd.DataFrame:
    """A factor's part of J'J p at both nodes."""
    ji, jj = _stacked(ji, 6, 6), _stacked(jj, 6, 6)
    at = np.einsum("nab,nb->na", ji, _stacked(pi, 6)) + np.einsum("nab,nb->na", jj, _stacked(pj, 6))
    return pd.DataFrame({"gi": list(np.einsum("nab,na->nb", ji, at)), "gj": list(np.einsum("nab,na->nb", jj, at))})


def _retracted(*parts: pd.Series) -> pd.DataFrame:
    t, x = _matrix(parts[:12]), _stacked(parts[12], 6)
    out = np.empty_like(t)
    out[:, :, :3] = t[:, :, :3] @ turns(x[:, 3:])
    out[:, :, 3] = t[:, :, 3] + np.einsum("nij,nj->ni", t[:, :, :3], x[:, :3])
    return pd.DataFrame(out.reshape(-1, 12), columns=POSE)


_VECTOR, _KEY = "array<double>", ["graph", "id"]
_zero = lambda n: F.array_repeat(F.lit(0.0), n)
_dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
_plus = lambda a, k, b: F.zip_with(a, b, lambda x, y: x + k * y)


def _summed(rows: DataFrame, *vectors: tuple[str, int]) -> DataFrame:
    """Sums of array columns by node, entry by entry."""
    sums = rows.groupBy(*_KEY).agg(*[F.sum(F.get(c, F.lit(k))).alias(f"_{c}{k}") for c, n in vectors for k in range(n)])
    return sums.select(*_KEY, *[F.array(*[f"_{c}{k}" for k in range(n)]).alias(c) for c, n in vectors])


def _ends(rows: DataFrame, *names: str) -> DataFrame:
    """Rows by node from rows by factor: fields named with i and j at their end."""
    side = lambda k: rows.where(F.col(k).isNotNull()).select("graph", F.col(k).alias("id"), *[F.col(f"p.{n}{k}").alias(n) for n in names])
    return side("i").unionByName(side("j"))


def _times(m, v):
    """A 6 x 6 block by a vector."""
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda r: _dot(F.slice(m, r * 6 + 1, F.lit(6)), v))


def solved_step(factors: DataFrame, most: int, tolerance: float) -> DataFrame:
    """factors (graph, i, j, ji, jj, res) -> (graph, id, x): the step for each node that has a factor, by preconditioned conjugate gradients."""
    first = F.pandas_udf(_starts, f"gi {_VECTOR}, bi {_VECTOR}, gj {_VECTOR}, bj {_VECTOR}")
    own = _summed(_ends(factors.select("graph", "i", "j", first("ji", "jj", "res").alias("p")), "g", "b"), ("g", 6), ("b", 36))
    state = own.select(*_KEY, F.transform("g", lambda v: -v).alias("r"), F.pandas_udf(_inverses, _VECTOR)("b").alias("m"))
    state = state.withColumn("z", _times(F.col("m"), F.col("r"))).withColumns({"x": _zero(6), "p": F.col("z"), "rz": _dot(F.col("r"), F.col("z"))})
    state = stored(state)
    start = state.agg(F.max("rz")).first()[0] or 0.0
    times = F.pandas_udf(_products, f"gi {_VECTOR}, gj {_VECTOR}")
    for _ in range(most if start > 0 else 0):
        p = state.select("graph", F.col("id").alias("_id"), "p")
        both = factors.alias("f").join(p.withColumnRenamed("p", "pj").alias("b"), (F.col("f.graph") == F.col("b.graph")) & (F.col("j") == F.col("b._id")))
        both = both.join(p.withColumnRenamed("p", "pi").alias("a"), (F.col("f.graph") == F.col("a.graph")) & (F.col("i") == F.col("a._id")), "left")
        both = both.select("f.graph", "i", "j", times("ji", "jj", F.coalesce("pi", _zero(6)), "pj").alias("p"))
        held = state.join(_summed(_ends(both, "g"), ("g", 6)), _KEY).withColumnRenamed("g", "q")
        held = stored(held)
        scale = held.groupBy("graph").agg(F.sum("rz").alias("_rz"), F.sum(_dot(F.col("p"), F.col("q"))).alias("_pq"))
        a = F.when(F.col("_pq") > 0, F.col("_rz") / F.col("_pq")).otherwise(0.0)
        moved = held.join(scale.select("graph", "_rz", a.alias("_a")), "graph")
        moved = moved.select(*_KEY, "m", "p", "_rz", _plus(F.col("x"), F.col("_a"), F.col("p")).alias("x"), _plus(F.col("r"), -F.col("_a"), F.col("q")).alias("r"))
        moved = moved.withColumn("z", _times(F.col("m"), F.col("r"))).withColumn("rz", _dot(F.col("r"), F.col("z")))
        moved = stored(moved)
        after = moved.groupBy("graph").agg(F.sum("rz").alias("_after"))
        b = F.when(F.col("_rz") > 0, F.col("_after") / F.col("_rz")).otherwise(0.0)
        state = moved.join(after, "graph").select(*_KEY, "m", "x", "r", "z", "rz", _plus(F.col("z"), b, F.col("p")).alias("p"))
        if (moved.agg(F.max("rz")).first()[0] or 0.0) <= tolerance**2 * start:
            break
    return state.select(*_KEY, "x")


def _dense(pdf: pd.DataFrame) -> pd.DataFrame:
    """The step of a whole small graph."""
    ji, jj, res = _stacked(pdf["ji"], 6, 6), _stacked(pdf["jj"], 6, 6), _stacked(pdf["res"], 6)
    held = pdf["i"].notna().to_numpy()
    ids = np.unique(np.concatenate([pdf["j"].to_numpy(np.int64), pdf["i"][held].to_numpy(np.int64)]))
    rows = np.arange(6 * len(pdf)).reshape(-1, 6)
    big = np.zeros((6 * len(pdf), 6 * len(ids)))
    at = lambda v: 6 * np.searchsorted(ids, v)[:, None] + np.arange(6)
    np.add.at(big, (rows[:, :, None], at(pdf["j"].to_numpy(np.int64))[:, None, :]), jj)
    np.add.at(big, (rows[held][:, :, None], at(pdf["i"][held].to_numpy(np.int64))[:, None, :]), ji[held])
    x = -np.linalg.pinv(big.T @ big, rcond=1e-12, hermitian=True) @ (big.T @ res.ravel())
    return pd.DataFrame({"graph": pdf["graph"].iloc[0], "id": ids, "x": list(x.reshape(-1, 6))})


def optimised(nodes: DataFrame, factors: DataFrame, rounds: int = 10, most: int = 200, tolerance: float = 1e-6, settle: float = 1e-6, small: int = 64) -> DataFrame:
    """The poses (graph, id, t00..t23) that fit the factors best: Gauss-Newton until no node moves by more than `settle`.
    Graphs of up to `small` nodes and 8 * small factors are solved whole, each in a task; larger ones by conjugate gradients."""
    nodes = stored(nodes.select(*_KEY, *[F.col(n).cast("double").alias(n) for n in POSE]))
    end = lambda k: nodes.select(F.col("graph").alias(f"_g{k}"), F.col("id").alias(f"_{k}"), *[F.col(n).alias(f"{k}{n}") for n in POSE])
    factors = stored(factors.select("graph", "i", "j", *MEASURED, "wt", "wr"))
    sizes = nodes.groupBy("graph").agg(F.count("*").alias("n")).join(factors.groupBy("graph").agg(F.count("*").alias("m")), "graph")
    large = stored(sizes.where(f"n > {small} OR m > {8 * small}").select("graph"))
    any_large = not large.isEmpty()
    linear = F.pandas_udf(_linear, f"ji {_VECTOR}, jj {_VECTOR}, res {_VECTOR}")
    retracted = F.pandas_udf(_retracted, ", ".join(f"{n} double" for n in POSE))
    for _ in range(rounds):
        at = factors.join(end("j"), (F.col("graph") == F.col("_gj")) & (F.col("j") == F.col("_j")))
        at = at.join(end("i"), (F.col("graph") == F.col("_gi")) & (F.col("i") == F.col("_i")), "left").where("i IS NULL OR _i IS NOT NULL")
        made = linear(*[f"i{n}" for n in POSE], *[f"j{n}" for n in POSE], *MEASURED, "wt", "wr")
        at = stored(at.select("graph", "i", "j", made.alias("p")).select("graph", "i", "j", "p.*"))
        step = at.join(large, "graph", "left_anti").groupBy("graph").applyInPandas(_dense, f"graph {dict(nodes.dtypes)['graph']}, id long, x {_VECTOR}")
        step = stored(step.unionByName(solved_step(at.join(large, "graph", "left_semi"), most, tolerance)) if any_large else step)
        moved = nodes.join(step, _KEY, "left").withColumn("x", F.coalesce("x", _zero(6)))
        nodes = stored(moved.select(*_KEY, retracted(*POSE, "x").alias("p")).select(*_KEY, "p.*"))
        if step.where(F.exists("x", lambda v: F.abs(v) > settle)).isEmpty():
            break
    return nodes
