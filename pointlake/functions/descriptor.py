"""Descriptor (row-major matrix in an array) functions: shifts, keys, column cosine, alignment, distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(d: Column, j: int, rings: int, sectors: int) -> Column:
    return F.array(*[F.get(d, F.lit(i * sectors + j)) for i in range(rings)])


def row(d: Column, i: int, sectors: int) -> Column:
    return F.slice(d, i * sectors + 1, sectors)


def shifted(d: Column, by: int, rings: int, sectors: int) -> Column:
    """Every row moved to the right by `by` columns, around the end (V1)."""
    k = by % sectors
    if not k:
        return d
    turn = lambda r: F.concat(F.slice(r, sectors - k + 1, k), F.slice(r, 1, sectors - k))
    return F.concat(*[turn(row(d, i, sectors)) for i in range(rings)])


def column_major(d: Column, rings: int, sectors: int) -> Column:
    """Flattened column by column (V2)."""
    return F.concat(*[column(d, j, rings, sectors) for j in range(sectors)])


def mean_of(a: Column, n: int) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n


def ring_key(d: Column, rings: int, sectors: int) -> Column:
    """Mean of each row over the dense grid."""
    return F.array(*[mean_of(row(d, i, sectors), sectors) for i in range(rings)])


def ring_occupancy(d: Column, rings: int, sectors: int) -> Column:
    """Share of non-zero cells of each row."""
    return F.array(*[F.size(F.filter(row(d, i, sectors), lambda v: v != 0)) / F.lit(float(sectors)) for i in range(rings)])


def sector_key(d: Column, rings: int, sectors: int) -> Column:
    """Mean of each column (A10)."""
    return F.array(*[mean_of(column(d, j, rings, sectors), rings) for j in range(sectors)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def column_cosine(a: Column, b: Column, rings: int, sectors: int) -> Column:
    """Mean cosine of the columns that are non-zero on both sides; null if there is none."""
    total, count = F.lit(0.0), F.lit(0)
    for j in range(sectors):
        x, y = column(a, j, rings, sectors), column(b, j, rings, sectors)
        n = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        total = total + F.when(n > 0, dot(x, y) / n).otherwise(0.0)
        count = count + F.when(n > 0, 1).otherwise(0)
    return F.when(count > 0, total / count)


def _similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n x rings x sectors twice -> n x sectors: mean column cosine for each shift of b; NaN where none qualifies."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    out = np.full((len(a), a.shape[2]), np.nan)
    for k in range(a.shape[2]):
        r, nr = np.roll(b, k, 2), np.roll(nb, k, 1)
        n = na * nr
        ok = n > 0
        cos = np.where(ok, (a * r).sum(1) / np.where(ok, n, 1), 0).sum(1)
        out[:, k] = np.where(ok.any(1), cos / np.maximum(ok.sum(1), 1), np.nan)
    return out


def _stack(s: pd.Series, rings: int, sectors: int) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in s]).reshape(-1, rings, sectors)


def similarity(rings: int, sectors: int):
    """UDF: best similarity over all shifts (V4, V7, U3); null where no column qualifies."""

    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        s = _similarities(_stack(a, rings, sectors), _stack(b, rings, sectors))
        return pd.Series(np.where(np.isnan(s).all(1), np.nan, np.nanmax(np.where(np.isnan(s), -np.inf, s), 1))).where(lambda v: np.isfinite(v), None)

    return udf


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c, rounded once, as in SQL's dot product of lists: its exact parts are added and their rest is rounded to odd."""
    p = a * b
    (ah, al), (bh, bl) = ((h := (t := 134217729.0 * v) - (t - v), v - h) for v in (a, b))
    upper, low = _two_sum(c, ((ah * bh - p) + ah * bl + al * bh) + al * bl)
    upper, rest = _two_sum(p, upper)
    s, e = _two_sum(low, rest)
    even = np.flatnonzero(e)
    even = even[s.view(np.int64)[even] & 1 == 0]
    s.view(np.int64)[even] += np.where((e[even] > 0) == (s[even] > 0), 1, -1)
    out = upper + s
    return np.where(np.isfinite(out), out, p + c)


def distances(x: np.ndarray, y: np.ndarray, share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """n x rings x sectors twice -> (dist, shift): coarse alignment on sector keys, then the exact distance around it (V3, V5, U2); NaN where no column qualifies."""
    at = np.arange(len(x))
    return aligned(laid_out(x), at, laid_out(y), at, share)


def laid_out(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n x rings x sectors as rings x sectors x n, with sector keys and column norms, for aligned()."""
    v = np.ascontiguousarray(d.transpose(1, 2, 0))
    return v, sum(v[1:], v[0]) / len(v), np.sqrt(sum((r * r for r in v[1:]), v[0] * v[0]))


def aligned(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """distances() for pairs of rows (i of a, j of b) of two laid_out() sets, a cell at a time over all pairs. Sums are taken in the order of SQL's lists, so that distances
    that are equal but for rounding are ordered as there; of equally near coarse alignments the first one with a common column counts."""
    (va, ka, na), (vb, kb, nb) = a, b
    rings, sectors, many = vb.shape
    reach = round(0.5 * share * sectors)
    kx, ky, nx, x = ka[:, i], kb[:, j], na[:, i], va[:, :, i]
    gaps = []
    for k in range(sectors):
        t = [kx[c] - ky[c - k] for c in range(sectors)]
        gaps.append(sum((v * v for v in t[1:]), t[0] * t[0]))
    least, coarse = gaps[0], np.zeros(len(i), np.int64)
    for k in range(1, sectors):
        near = gaps[k] < least
        coarse[near], least = k, np.where(near, gaps[k], least)

    def around(w, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, turn = np.full(len(coarse), np.inf), np.zeros(len(coarse), np.int32)
        for k in {d % sectors for d in range(-reach, reach + 1)}:
            to = (coarse + k) % sectors
            total, count = 0.0, 0
            for c in range(sectors):
                at = (c - to) % sectors * many + j[w]
                n = nx[c, w] * nb.ravel().take(at)
                ok = n > 0
                dot = x[0, c, w] * vb[0].ravel().take(at)
                for r in range(1, rings):
                    dot = fused(x[r, c, w], vb[r].ravel().take(at), dot)
                total = total + np.where(ok, dot / np.where(ok, n, 1), 0)
                count = count + ok
            now = np.where(count > 0, 1 - total / np.maximum(count, 1), np.inf)
            now[np.isnan(now)] = np.inf
            less = (now < best) | ((now == best) & (now < np.inf) & (to < turn))
            best[less], turn[less] = now[less], to[less]
        return np.where(np.isfinite(best), best, np.nan), turn

    dist, turn = around(slice(None), coarse)
    for k in range(1, sectors):
        again = np.flatnonzero(np.isnan(dist) & (gaps[k] == least) & (coarse < k))
        if len(again):
            dist[again], turn[again] = around(again, np.full(len(again), k))
    return dist, turn


def pair_distances(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, share: float = 0.1) -> np.ndarray:
    """The distances alone of aligned()."""
    return aligned(a, i, b, j, share)[0]


def distance(rings: int, sectors: int, share: float = 0.1):
    """UDF: struct(dist, shift) of distances(); its `arrays` are what gives the same of pairs of matrices in a task."""

    @F.pandas_udf("dist double, shift int")
    def udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        dist, best = distances(_stack(a, rings, sectors), _stack(b, rings, sectors), share)
        return pd.DataFrame({"dist": dist, "shift": best})

    udf.arrays = laid_out, lambda a, i, b, j: pair_distances(a, i, b, j, share)
    return udf


def cosine_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of a with all rows of b."""
    return (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T


def _columns(d: np.ndarray, rings: int, sectors: int) -> tuple[np.ndarray, np.ndarray]:
    """n x (rings * sectors) -> the same with columns of length 1 (zero ones stay), and n x sectors: 1.0 where a column is not zero."""
    d = d.reshape(-1, rings, sectors)
    size = np.linalg.norm(d, axis=1)
    return d / np.where(size == 0, 1.0, size)[:, None], (size != 0).astype(float)


def shift_similarities(a: np.ndarray, b: np.ndarray, rings: int, sectors: int, shifts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each shift of b the mean column cosines of all rows of a with all of b (M24), and where there is none."""
    (ua, ha), (ub, hb) = _columns(a, rings, sectors), _columns(b, rings, sectors)
    flat, out = ua.reshape(len(ua), -1), []
    for k in shifts:
        n = ha @ np.roll(hb, k, 1).T
        out.append((flat @ np.roll(ub, k, 2).reshape(len(ub), -1).T / np.where(n == 0, 1.0, n), n == 0))
    return out


def coarse_shift(a: np.ndarray, b: np.ndarray, rings: int, sectors: int) -> np.ndarray:
    """The shift of b that brings its sector keys nearest to those of a, for all rows of a with all of b; the smallest of equal ones (V3)."""
    ka, kb = (sum(v.reshape(-1, rings, sectors)[:, r] for r in range(rings)) / rings for v in (a, b))
    least = best = None
    for k in range(sectors):
        gap = np.zeros((len(ka), len(kb)))
        for j in range(sectors):
            t = ka[:, j, None] - kb[None, :, (j - k) % sectors]
            gap += t * t
        if k:
            near = gap < least
            best[near] = k
            np.minimum(least, gap, out=least)
        else:
            least, best = gap, np.zeros(gap.shape, np.int32)
    return best


def mirrored(pairs: DataFrame) -> DataFrame:
    """The other triangle of a half matrix (i, j, sim) added (V8)."""
    return pairs.unionByName(pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))
