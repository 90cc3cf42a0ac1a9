"""Running products that do not commute (W6, W9, W12, W26), as a scan over blocks of rows.

Rows are dealt out by ranges of key and order, so a long key spans several blocks and no key loads one task. Each block makes the running
products of its rows from its own start; the products of whole blocks, of which there are at most two for each boundary
between blocks, are scanned for each key; and each row is multiplied by the product of the blocks of its key before its own. Within a task
rows are cut into lanes that step together in numpy, and the lanes' totals are scanned in the same way.

A null key is a key of its own. Rows of a key with equal order come in any order. All other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pointlake.functions.geometry import composed
from pointlake.session import stored

LANE = 64


@dataclass(frozen=True)
class Product:
    """An associative product of rows of numbers, in numpy and in columns."""

    one: tuple[float, ...]
    rows: Callable[[np.ndarray, np.ndarray], np.ndarray]
    columns: Callable[[list, list], list]


def _rigid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.reshape(-1, 3, 4), b.reshape(-1, 3, 4)
    out = a[:, :, :3] @ b
    out[:, :, 3] += a[:, :, 3]
    return out.reshape(-1, 12)


def _turns(a, b) -> list:
    """Product of quaternions (w, x, y, z), of numbers, arrays or columns."""
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return [
        aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw,
    ]


RIGID = Product((1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0), _rigid, composed)
QUATERNION = Product((1, 0, 0, 0), lambda a, b: np.stack(_turns(a.T, b.T), 1), _turns)


def scanned(x: np.ndarray, first: np.ndarray, op) -> np.ndarray:
    """Running products of rows; `first` has the first row of every segment, ascending from 0."""
    size = np.diff(first, append=len(x))
    lanes = -(-size // LANE)
    lane_first = np.cumsum(lanes) - lanes
    of = np.repeat(np.arange(len(first)), lanes)
    start = first[of] + (np.arange(len(of)) - lane_first[of]) * LANE
    length = np.minimum(first[of] + size[of] - start, LANE)
    out = x.copy()
    for step in range(1, int(length.max(initial=1))):
        at = start[length > step] + step
        out[at] = op(out[at - 1], x[at])
    if len(of) > len(first):
        before = scanned(out[start + length - 1], lane_first, op)
        later = np.flatnonzero(np.arange(len(of)) != lane_first[of])
        lane = np.repeat(later, length[later])
        at = start[lane] + np.arange(len(lane)) - np.repeat(np.cumsum(length[later]) - length[later], length[later])
        out[at] = op(before[lane - 1], out[at])
    return out


def _changes(batch: pa.RecordBatch, names: list[str], last: list | None) -> np.ndarray:
    """Where a row's key differs from the row before; last: the key before the batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = last is None or any(batch.column(n)[0].as_py() != v for n, v in zip(names, last))
    for n in names:
        c = batch.column(n)
        a, b = c[1:], c[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return new


def prefix_product(df: DataFrame, key: list[str], order: list[str], names: list[str], product: Product, left: bool = False, parts: int | None = None) -> DataFrame:
    """Columns `names` replaced by the running product of each key's rows in order; left: new factors on the left. The blocks are stored."""
    columns, one = df.columns, np.array(product.one, float)
    op = (lambda a, b: product.rows(b, a)) if left else product.rows
    by = [*key, *order]
    rows = (df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)).sortWithinPartitions(*by)
    rows = rows.withColumns({n: F.col(n).cast("double") for n in names}).withColumn("_block", F.spark_partition_id()).withColumn("_row", F.lit(0).cast("long"))
    schema = to_arrow_schema(rows.schema)

    def local(batches):
        last, total, seen = None, one, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], 1)
            new = _changes(batch, key, last)
            if not new[0]:
                x[0] = op(total[None], x[:1])[0]
            out = scanned(x, np.flatnonzero(new | (np.arange(len(new)) == 0)), op)
            total, last = out[-1], [batch.column(n)[-1].as_py() for n in key]
            made = {n: pa.array(out[:, i]) for i, n in enumerate(names)} | {"_row": pa.array(np.arange(seen, seen + len(out)))}
            seen += len(out)
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    done = stored(rows.mapInArrow(local, rows.schema))
    ends = done.groupBy(*key, "_block").agg(F.max_by(F.struct(*names), "_row").alias("_total"))
    several = ends.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
    same = lambda a, b: [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)]
    keys = [f"_k{i}" for i in range(len(key))]
    ends = ends.join(several, same(key, keys)).select(*keys, F.col("_block").alias("_b"), *[F.col(f"_total.{n}").alias(f"_t{i}") for i, n in enumerate(names)])
    totals = [f"_t{i}" for i in range(len(names))]
    end_schema = to_arrow_schema(ends.schema)

    def before(group: pa.Table) -> pa.Table:
        group = group.sort_by("_b")
        x = np.stack([group[t].to_numpy() for t in totals], 1)
        held = np.vstack([one[None], scanned(x, np.array([0]), op)[:-1]])
        return pa.Table.from_arrays([*[group[c] for c in (*keys, "_b")], *[pa.array(held[:, i]) for i in range(len(totals))]], schema=end_schema)

    head = ends.groupBy(*keys).applyInArrow(before, ends.schema)
    joined = done.join(head, [*same(key, keys), F.col("_block") == F.col("_b")], "left")
    own, held = [F.col(n) for n in names], [F.col(t) for t in totals]
    full = product.columns(own, held) if left else product.columns(held, own)
    made = {n: F.when(F.col("_b").isNull(), F.col(n)).otherwise(v).alias(n) for n, v in zip(names, full)}
    return joined.select(*[made.get(c, F.col(c)) for c in columns])
