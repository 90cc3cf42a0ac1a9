"""Embedding whitening: the principal components of all vectors, and every vector projected on them at unit variance.

A vector's entries c become x = floor(64 * c) + SHIFT, whole numbers, so counts and sums are exact. Every partition keeps one
state (rows n, sums S, and M, the sum of products of deviations) and takes rows in by Welford's rank-one update: a row's
deviation from the mean before it times its deviation from the mean after it. The updates of a batch are added up in one
matrix product, with the running means taken from exact running sums of x - SHIFT. States are merged by the parallel
update (M of both, plus the outer product of the difference of means times n_a n_b / n), FAN of them in a task, until one round of
at most FAN is left for the driver: a state has dimension**2 numbers, whatever the number of rows. The driver solves the
eigenproblem of M / n by Householder reduction to a tridiagonal matrix and symmetric QR steps with Wilkinson's shift.

A second pass whitens and measures the covariance of what it whitened, again by Welford states, so identity_error is a measured
figure; the last pass returns a row for each vector and component, up to `most`.

Left out: null vectors, vectors with a null or non-finite entry, and such as no long holds in exact arithmetic (|64 * c| of 2**52
or more). The dimension is the commonest length of what is left (of equally common ones the largest); vectors of another
length have no place in the covariance and are left out as well. Rows of one vec_id, and rows without one, each count and return. A component
whose eigenvalue is nil to rounding has no whitened value (null) and no part in identity_error; with no variance at all,
explained is null, without such components identity_error is too. A deviation beyond a long is null. Of a component's two directions that is taken whose
largest entry is positive. Empty tables give no rows. Only vec_id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import arrow, bounded, sliced, table

SHIFT, SCALE, MOST, FAN = 1_000_000, 64, 32, 32
_STATE = "size int, part long, n long, sums binary, moments binary"
#: States that a partition holds at once; vectors of still more lengths are handed on in several states.
_LENGTHS = 8


def whole(col: pa.Array, size: int | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, floor(64 c) as int64 rows) for the usable vectors of each length, or of one length."""
    place = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
    length = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)[place]
    out = []
    for d in [size] if size is not None else np.unique(length):
        at = place[length == d]
        flat = col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
        with np.errstate(invalid="ignore", over="ignore"):
            y = np.floor(flat * SCALE)
            ok = (np.abs(y) < 2.0**52).all(1)
        out.append((int(d), at[ok], y[ok].astype(np.int64)))
    return out


@dataclass
class State:
    """Welford's state: rows, their sums (exact, of whole numbers) and the sum of products of deviations from the mean."""

    n: int
    sums: np.ndarray
    moments: np.ndarray

    def take(self, x: np.ndarray) -> None:
        """Takes rows in, one rank-one update each, the updates of all rows added up in one product."""
        count = self.n + np.arange(1, len(x) + 1)[:, None]
        after = self.sums + np.cumsum(x, 0)
        last = np.vstack([self.sums[None], after[:-1]])
        before = last / np.maximum(count - 1, 1)
        self.moments += ((x - before) * (count > 1)).T @ (x - after / count)
        self.n, self.sums = self.n + len(x), after[-1]

    def merge(self, o: State) -> None:
        """The parallel update."""
        if self.n and o.n:
            gap = o.sums / o.n - self.sums / self.n
            self.moments += np.outer(gap, gap) * (self.n * o.n / (self.n + o.n))
        self.moments += o.moments
        self.n, self.sums = self.n + o.n, self.sums + o.sums

    def row(self, size: int, part: int) -> tuple:
        return size, part, self.n, self.sums.tobytes(), self.moments.tobytes()


def _empty(d: int, kind=np.int64) -> State:
    return State(0, np.zeros(d, kind), np.zeros((d, d)))


def _read(size: int, n: int, sums: bytes, moments: bytes, kind) -> State:
    return State(n, np.frombuffer(sums, kind).copy(), np.frombuffer(moments).reshape(size, size).copy())


def _states(rows: DataFrame, of, kind=np.int64) -> list[tuple[int, State]]:
    """The merged state of each length; of(record batch) gives (length, rows) pairs."""
    bounded(rows.sparkSession)

    def gather(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in sliced(batch) if batch.num_rows else []:
                for d, x in of(piece):
                    if len(x):
                        if d not in held and len(held) >= _LENGTHS:
                            yield _record([s.row(k, part) for k, s in held.items()])
                            held = {}
                        held.setdefault(d, _empty(d, kind)).take(x)
        if held:
            yield _record([s.row(k, part) for k, s in held.items()])

    def merge(group: pa.Table) -> pa.Table:
        size, part = group["size"][0].as_py(), group["part"][0].as_py()
        total = _empty(size, kind)
        for i in range(group.num_rows):
            total.merge(_read(size, *(group[c][i].as_py() for c in ("n", "sums", "moments")), kind))
        return pa.Table.from_batches([_record([total.row(size, part)])])

    found, parts = rows.mapInArrow(gather, _STATE), max(rows.rdd.getNumPartitions(), 1)
    while parts > 1:
        parts = -(-parts // FAN)
        found = found.withColumn("part", F.expr(f"part div {FAN}")).groupBy("size", "part").applyInArrow(merge, _STATE)
    best = found.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return [(r["size"], _read(r["size"], r["n"], r["sums"], r["moments"], kind)) for r in best]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["size", "part", "n", "sums", "moments"])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reduction: (diagonal, off-diagonal, Q) with Q' a Q tridiagonal."""
    a, n = a.copy(), len(a)
    q, nil = np.eye(n), np.finfo(float).eps ** 2 * np.abs(a).max(initial=0)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm <= nil:
            a[k + 1 :, k] = a[k, k + 1 :] = 0
            continue
        lead = np.copysign(norm, x[0])
        v = x.copy()
        v[0] += lead
        v /= np.linalg.norm(v)
        sub = a[k + 1 :, k + 1 :]
        p = sub @ v
        w = p - v * (v @ p)
        sub -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -lead
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors in columns) by implicit QR steps with Wilkinson's shift on the tridiagonal form."""
    d, e, q = tridiagonal(np.asarray(a, float))
    q, n, eps = np.ascontiguousarray(q.T), len(d), np.finfo(float).eps
    hi, nil = n - 1, eps**2 * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0))
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1])) + nil
        e[:hi][small] = 0
        if small[hi - 1]:
            hi -= 1
            continue
        cut = np.flatnonzero(small)
        lo = int(cut[-1]) + 1 if len(cut) else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p0, p1, off = d[k], d[k + 1], e[k]
            d[k] = c * c * p0 + 2 * c * s * off + s * s * p1
            d[k + 1] = s * s * p0 - 2 * c * s * off + c * c * p1
            e[k] = c * s * (p1 - p0) + (c * c - s * s) * off
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[[k, k + 1]] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    vectors = q[order].T
    lead = vectors[np.abs(vectors).argmax(0), np.arange(n)] if n else np.zeros(0)
    return d[order], vectors * np.where(lead < 0, -1, 1)


@dataclass
class Model:
    """What whitening needs: n and exact sums of floor(64 c), eigenvalues, directions (columns) and 1 / sqrt(eigenvalue), nil where that is."""

    size: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    stretch: np.ndarray
    identity_error: float | None = None

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return ((y - self.sums / self.n) @ self.vectors) * self.stretch


def fit(rows: DataFrame, vector: str = "embedding", most: int = MOST) -> Model | None:
    """The model of all usable vectors; None where there are none."""
    best = _states(rows.select(vector), lambda b: [(d, y) for d, _, y in whole(b.column(0))])
    if not best or not best[0][0]:
        return None
    size, s = best[0]
    values, vectors = symmetric_qr(s.moments / s.n)
    trace, keep = float(np.trace(s.moments) / s.n), min(most, size)
    real = values[:keep] > max(trace, 0) * size * np.finfo(float).eps
    model = Model(size, s.n, s.sums, values[:keep], vectors[:, :keep], trace, np.where(real, 1 / np.sqrt(np.where(real, values[:keep], 1)), 0.0))
    if real.any():
        held = rows.sparkSession.sparkContext.broadcast(model)
        measured = _states(rows.select(vector), lambda b: [(keep, held.value.whitened(y)) for _, _, y in whole(b.column(0), held.value.size)], np.float64)[0][1]
        model.identity_error = float(np.abs((measured.moments / measured.n - np.eye(keep))[np.ix_(real, real)]).max())
    return model


def deviation(y: np.ndarray, model: Model) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2, exact; None beyond a long. The shift falls out of the difference."""
    with np.errstate(over="ignore"):
        about = ((y * float(model.n) - model.sums) ** 2).sum(1)
    if len(y) and max(float(np.abs(y).max()) * model.n, float(about.max())) < 2.0**62:
        return ((y * model.n - model.sums) ** 2).sum(1).tolist()
    exact = [sum((int(v) * model.n - int(s)) ** 2 for v, s in zip(r, model.sums)) for r in y]
    return [v if v < 2**63 else None for v in exact]


def whitened(rows: DataFrame, model: Model | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    fields = f"{key} {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], fields)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        m = held.value
        (_, at, y) = whole(batch.column(1), m.size)[0]
        k, count = len(m.values), len(at)
        every = lambda x: np.tile(x, count)
        nil = every(m.stretch == 0)
        far = deviation(y, m)
        return {
            key: batch.column(0).take(pa.array(np.repeat(at, k))), "component": every(np.arange(1, k + 1)), "n": np.full(count * k, m.n),
            "deviation": pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(count), k))),
            "whitened": pa.array(m.whitened(y).ravel(), mask=nil), "explained": pa.array(every(m.values / (m.trace or 1.0)), mask=np.full(count * k, m.trace <= 0)),
            "identity_error": pa.array([m.identity_error] * (count * k), pa.float64()),
        }

    return arrow(rows.select(key, vector), run, fields)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitened(rows, fit(rows))
