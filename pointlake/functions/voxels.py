"""Ray traversal of a voxel grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def walk(start: np.ndarray, end: np.ndarray, size: float) -> list[tuple[int, int, int]]:
    """Voxels that a segment passes, in order; where it leaves through an edge or corner, the voxels that share it too."""
    at = np.floor(np.asarray(start, float) / size).astype(int)
    to = np.floor(np.asarray(end, float) / size).astype(int)
    d = np.asarray(end, float) - np.asarray(start, float)
    step = np.sign(d).astype(int)
    with np.errstate(divide="ignore", invalid="ignore"):
        edge = (at + (step > 0)) * size
        t = np.where(step != 0, (edge - start) / d, np.inf)
        dt = np.where(step != 0, size / np.abs(d), np.inf)
    out = [tuple(at.tolist())]
    for _ in range(int(np.abs(to - at).sum()) + 3):
        if (at == to).all() or np.min(t) > 1:
            break
        axes = np.flatnonzero(t <= np.min(t) + 1e-12)
        if len(axes) > 1 and len(set(step[axes])) > 1:
            for a in axes:
                side = at.copy()
                side[a] += step[a]
                out.append(tuple(side.tolist()))
        at = at.copy()
        at[axes] += step[axes]
        t[axes] += dt[axes]
        out.append(tuple(at.tolist()))
    return list(dict.fromkeys(out))


def walk_voxels(size: float, leave_out: int = 5):
    """UDF (x0, y0, z0, x1, y1, z1) -> array of voxels; the last `leave_out` steps are left out."""

    @F.pandas_udf("array<struct<vx: bigint, vy: bigint, vz: bigint>>")
    def udf(x0: pd.Series, y0: pd.Series, z0: pd.Series, x1: pd.Series, y1: pd.Series, z1: pd.Series) -> pd.Series:
        rows = np.stack([s.to_numpy(float) for s in (x0, y0, z0, x1, y1, z1)], 1)
        return pd.Series([[dict(zip(("vx", "vy", "vz"), v)) for v in walk(r[:3], r[3:], size)[: -leave_out or None]] for r in rows])

    return udf
