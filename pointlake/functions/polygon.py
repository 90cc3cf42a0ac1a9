"""Convex polygons: hull, area, clipping, overlap ratios (A26, M14-M20), in numpy and as UDFs on arrays of (x, y)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without collinear points (monotone chain)."""
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and _cross(out[-1] - out[-2], p - out[-1]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _cross(a, b) -> float:
    return float(a[0] * b[1] - a[1] * b[0])


def area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def crossing(a, b, c, d):
    """The point where segments ab and cd meet, or None."""
    a, b, c, d = (np.asarray(p, float) for p in (a, b, c, d))
    n = _cross(b - a, d - c)
    if n == 0:
        return None
    s, t = _cross(c - a, d - c) / n, _cross(c - a, b - a) / n
    return a + s * (b - a) if 0 <= s <= 1 and 0 <= t <= 1 else None


def clipped(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The part of p on the left of the line from a to b."""
    side = [_cross(b - a, q - a) for q in p]
    out = []
    for i, q in enumerate(p):
        j = (i + 1) % len(p)
        if side[i] >= 0:
            out.append(q)
        if side[i] * side[j] < 0:
            out.append(q + (p[j] - q) * (side[i] / (side[i] - side[j])))
    return np.array(out).reshape(-1, 2)


def intersection(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    for i in range(len(q)):
        if not len(p):
            break
        p = clipped(p, q[i], q[(i + 1) % len(q)])
    return p


def overlap(p, q) -> tuple[float, float, float, float]:
    """(intersection area, share of p, share of q, intersection over union) of two convex hulls."""
    p, q = hull(p), hull(q)
    a, b = area(p), area(q)
    both = area(intersection(p, q)) if a and b else 0.0
    return both, both / a if a else 0.0, both / b if b else 0.0, both / (a + b - both) if a + b > both else 0.0


def _overlaps(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    xy = lambda v: np.array([[q["x"], q["y"]] if isinstance(q, dict) else [q[0], q[1]] for q in v], float).reshape(-1, 2)
    return pd.DataFrame([overlap(xy(x), xy(y)) for x, y in zip(a, b)], columns=["inter", "share_a", "share_b", "iou"])


def convex_overlap(a, b) -> Column:
    """Overlap of two point arrays' hulls (U5); hulls collide where inter > 0."""
    return F.pandas_udf(_overlaps, "inter double, share_a double, share_b double, iou double")(a, b)


def shoelace(xs: Column, ys: Column) -> Column:
    """Area of a ring given as two arrays, built-in expressions only."""
    turn = lambda a: F.concat(F.slice(a, 2, F.size(a)), F.slice(a, 1, 1))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.abs(total(xs, turn(ys)) - total(ys, turn(xs))) / 2


def meeting(a: tuple, b: tuple, c: tuple, d: tuple) -> tuple[Column, Column]:
    """x and y where segments ab and cd meet, null if they don't (M17); points are pairs of columns."""
    turn = lambda p, q: p[0] * q[1] - p[1] * q[0]
    ab, cd, ac = ((q[0] - p[0], q[1] - p[1]) for p, q in ((a, b), (c, d), (a, c)))
    n = F.nullif(turn(ab, cd), F.lit(0.0))
    s, t = turn(ac, cd) / n, turn(ac, ab) / n
    hit = s.between(0, 1) & t.between(0, 1)
    return F.when(hit, a[0] + s * ab[0]), F.when(hit, a[1] + s * ab[1])
