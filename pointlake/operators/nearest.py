"""The k nearest rows within a radius, in rounds of growing reach (J10-J15, J32): a row that has its k neighbours within a small reach has them for good, so only the others
are looked at again with twice the reach, up to the radius. Rows meet in grid cells that are fitted to the reach and hold some PER_CELL rows in the first round; a task
takes a cell at a time and keeps k of each row, so no table of all pairs within the radius is made."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointlake.operators.blocks import small_batches

PER_CELL, TILE = 512, 1 << 20
_XYZ = ("x", "y", "z")


def first_reach(rows: DataFrame, r: float, key: list[str] = ()) -> float:
    """A reach whose cells (four times as wide) hold about PER_CELL rows where rows are as dense as between the quartiles; r if that is smaller."""
    most = rows.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    q = rows.agg(*[F.percentile_approx(c, [0.25, 0.75], 1000).alias(c) for c in _XYZ]).first()
    if not most:
        return r
    side = [max(q[c][1] - q[c][0], r / 512) / 1.349 for c in _XYZ]
    reach = (PER_CELL * 44.5 * side[0] * side[1] * side[2] / most) ** (1 / 3) / 4
    return r if reach * 1.5 >= r else reach


def _arrays(batch, name: str, r: int, cols: list[str]) -> dict[str, np.ndarray]:
    v = batch.column(batch.schema.names.index(name))[r].values
    return {c: v.field(k).to_numpy(zero_copy_only=False) for k, c in enumerate(cols)}


def _picked(a: dict, b: dict, k: int, reach2: float, allowed: Callable | None, id: str):
    """For a part of a: (row of a, row of b, d2) of its k nearest in b, which is in the order of the id."""
    d2 = np.zeros((len(a[id]), len(b[id])))
    for c in _XYZ:
        t = a[c][:, None] - b[c][None, :]
        d2 += t * t
    ok = d2 <= reach2
    if allowed is not None:
        ok &= allowed({c: v[:, None] for c, v in a.items()}, {c: v[None, :] for c, v in b.items()})
    d2[~ok] = np.inf
    rows = np.arange(len(d2))
    for _ in range(min(k, d2.shape[1])):
        at = d2.argmin(1)  # of equal ones the first, so the smallest id
        gap = d2[rows, at]
        found = np.flatnonzero(np.isfinite(gap))
        if not len(found):
            return
        yield found, at[found], gap[found]
        d2[rows, at] = np.inf


def _round(left: DataFrame, right: DataFrame, k: int, reach: float, width: float, key: list[str], allowed: Callable | None, id: str) -> DataFrame:
    cells, far = [f"_c{i}" for i in range(3)], reach * (1 + 1e-9)
    a, b = left, right
    for n, c in zip(cells, _XYZ):
        pad = far + F.abs(c) * 1e-12
        a = a.withColumn(n, F.explode(F.sequence(F.floor((F.col(c) - pad) / width), F.floor((F.col(c) + pad) / width))))
        b = b.withColumn(n, F.floor(F.col(c) / width))
    of_a, of_b = ([c for c in df.columns if c not in key] for df in (left, right))
    a = a.groupBy(*key, *cells).agg(F.collect_list(F.struct(*of_a)).alias("_a"))
    b = b.groupBy(*key, *cells).agg(F.collect_list(F.struct(*of_b)).alias("_b"))
    met = a.join(b, [*key, *cells]).select(*key, "_a", "_b")
    types = dict(left.dtypes)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                one, two = _arrays(batch, "_a", r, of_a), _arrays(batch, "_b", r, of_b)
                order = np.argsort(two[id], kind="stable")
                two = {c: v[order] for c, v in two.items()}
                step = max(1, TILE // len(order))
                found = []
                for at in range(0, len(one[id]), step):
                    part = {c: v[at : at + step] for c, v in one.items()}
                    found += [(part[id][i], two[id][j], gap) for i, j, gap in _picked(part, two, k, reach * reach, allowed, id)]
                if found:
                    cols = [pa.array(np.concatenate(v)) for v in zip(*found)]
                    held = [pa.array([batch.column(n)[r].as_py()] * len(cols[0]), batch.schema.field(n).type) for n in range(len(key))]
                    yield pa.RecordBatch.from_arrays([*held, *cols], names=[*key, id, f"{id}_r", "d2"])

    small_batches(left.sparkSession)
    near = met.mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in key], f"{id} {types[id]}", f"{id}_r {dict(right.dtypes)[id]}", "d2 double"]))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(id, *key).orderBy("d2", f"{id}_r"))).where(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, k: int, r: float, key: list[str] = (), allowed: Callable | None = None, id: str = "id", reach: float | None = None) -> DataFrame:
    """(key, id, id_r, d2, rank): the k nearest right rows within r of each left row, ranked by (d2, id_r). left, right: id (distinct within a key), x, y, z, key and
    numeric columns that `allowed` reads: it takes two dicts of columns (left ones upright, right ones lying) and says which pairs count. Rows with a null or non-finite
    coordinate or a null key have no neighbours."""
    from pointlake.session import stored

    key = list(key)
    real = lambda df: df.where(" AND ".join([*[f"abs({c}) < double('infinity')" for c in _XYZ], *[f"{c} IS NOT NULL" for c in (*key, id)]]))
    todo, right = real(left), real(right)
    reach = min(r, reach or first_reach(right, r, key))
    out, width = None, 4 * reach
    while reach < r:
        found = stored(_round(todo, right, k, reach, width, key, allowed, id))
        full = found.where(F.col("rank") == k).select(id, *key)
        done = found.join(full, [id, *key], "left_semi")
        out = done if out is None else out.unionByName(done)
        todo = stored(todo.join(full, [id, *key], "left_anti"))
        if todo.isEmpty():
            return out
        reach, width = min(r, 2 * reach), 4 * reach
    last = _round(todo, right, k, r, width, key, allowed, id)
    return last if out is None else out.unionByName(last)
