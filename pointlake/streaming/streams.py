"""Streaming operators (J4-J9, T1-T13, U11) on Structured Streaming.

Exact drop-oldest queues have no place in a lossless engine: bounds are watermarks, time-to-live and list state, and
the functions say where the outcome differs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def interval_stream_join(left: DataFrame, right: DataFrame, tolerance: float, delay: str, keys: list[str] = ()) -> DataFrame:
    """ts_r within [ts - tolerance, ts + tolerance) seconds; both sides carry watermarks, so state ends.

    A stream join needs an equality: time is cut into buckets of twice the tolerance, and left rows are listed in two.
    """
    width, micros = int(2e6 * tolerance), int(1e6 * tolerance)
    low = F.floor((F.unix_micros("ts") - micros) / width)
    a = left.withWatermark("ts", delay).withColumn("_slot", F.explode(F.array(low, low + 1))).alias("a")
    b = right.withWatermark("ts_r", delay).withColumn("_slot", F.floor(F.unix_micros("ts_r") / width)).alias("b")
    on = F.expr(f"a._slot = b._slot and b.ts_r >= a.ts - interval {micros} microseconds and b.ts_r < a.ts + interval {micros} microseconds")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on).drop("_slot")


def equi_stream_join(streams: list[DataFrame], stamp: str = "stamp", delay: str = "1 second") -> DataFrame:
    """Rows of all streams with the same stamp, as a chain of joins; heads that are later than the watermark are discarded. A stamp
    that one stream lacks gives no row (J6, J7 with repeated rows and the strict form: aligned)."""
    out = streams[0].withWatermark(stamp, delay)
    for s in streams[1:]:
        out = out.join(s.withWatermark(stamp, delay), stamp)
    return out


def aligned(streams: list[DataFrame], key: list[str], stamp: str = "stamp", delay: str = "1 second", strict: bool = False) -> DataFrame:
    """One row (key, stamp, s0, s1, ...) for every stamp of a key that all streams have, s<i> the other columns of stream i; tables or
    streams. The streams are tagged and united, and a stamp waits as one group until the watermark passes it. Rows later than that
    are dropped (stale heads). A stamp that a stream lacks gives no row, or, if strict, fails the query and names the stamp. Of
    repeated rows of a stream, key and stamp the smallest counts. Rows without a stamp match nothing."""
    parts = []
    for i, s in enumerate(streams):
        own = F.struct(*[c for c in s.columns if c not in (*key, stamp)])
        kinds = [F.lit(None).cast(t.select(F.struct(*[c for c in t.columns if c not in (*key, stamp)])).schema[0].dataType) for t in streams]
        parts.append(s.where(F.col(stamp).isNotNull()).withWatermark(stamp, delay).select(*key, stamp, *[(own if i == k else none).alias(f"s{k}") for k, none in enumerate(kinds)]))
    both, names = parts[0], [f"s{k}" for k in range(len(streams))]
    for p in parts[1:]:
        both = both.unionByName(p)
    out = both.groupBy(*key, stamp).agg(*[F.min(n).alias(n) for n in names])
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    if strict:
        whole = F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("a stream lacks the stamp "), F.col(stamp).cast("string"))).cast("boolean"))
    return out.where(whole)


def latest_only(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of a micro-batch only the latest row of each key, for foreachBatch: what a cleared backlog leaves."""
    others = [c for c in batch.columns if c not in key]
    m = batch.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_m"))
    return m.select(*key, "_m.*")


def with_latest(stream: DataFrame, corrections: DataFrame, key: list[str]) -> DataFrame:
    """Each row with its key's latest correction (static side: key, correction columns, one row for each key)."""
    return stream.join(corrections, key, "left")


def throttled(stream: DataFrame, interval: str, delay: str, key: list[str], order: str = "ts") -> DataFrame:
    """T6 by event time: the first row of each interval. A gate that counts from the last kept row is `gated`."""
    others = [c for c in stream.columns if c not in (*key, order)]
    w = stream.withWatermark(order, delay).groupBy(F.window(order, interval), *key)
    return w.agg(F.min(F.struct(order, *others)).alias("_m")).select(*key, "_m.*")


def _stateful(stream: DataFrame, key: str, out: str, state: str, step, ttl_ms: int | None = None) -> DataFrame:
    """Rows of a key in order of ts through step(state, row) -> (state, rows out); state ends ttl after its last row."""

    def run(k, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        if s.hasTimedOut:
            s.remove()
            return
        now = s.get if s.exists else None
        rows: list[tuple] = []
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for r in pdf.itertuples(index=False):
            now, more = step(now, r)
            rows += [(k[0], *x) for x in more]
        s.update(now)
        if ttl_ms:
            s.setTimeoutDuration(ttl_ms)
        names = [c.strip().split(" ")[0] for c in out.split(", ")]
        if rows:
            yield pd.DataFrame(rows, columns=names)

    mode = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", mode)


def gated(stream: DataFrame, key: str, seconds: float, ttl_ms: int | None = None) -> DataFrame:
    """T6, W22 on a stream: rows at least `seconds` after the last row let through (t in seconds)."""

    def step(s, r):
        return (s, []) if s is not None and r.t - s[0] < seconds else ((float(r.t),), [(float(r.t),)])

    return _stateful(stream, key, f"{key} long, t double", "last double", step, ttl_ms)


def last_n(stream: DataFrame, key: str, n: int = 13) -> DataFrame:
    """The last n values of each key with each new one, once there are n (n = 2: two-frame pairs)."""

    def step(s, r):
        q = [*(s[0] if s is not None else []), float(r.value)][-n:]
        return (q,), [(float(r.t), q)] if len(q) == n else []

    return _stateful(stream, key, f"{key} long, t double, frames array<double>", "q array<double>", step)


def warm(stream: DataFrame, key: str, skip: int = 6) -> DataFrame:
    """Each key's first `skip` rows are dropped."""

    def step(s, r):
        n = (s[0] if s is not None else 0) + 1
        return (n,), [(float(r.t), float(r.value))] if n > skip else []

    return _stateful(stream, key, f"{key} long, t double, value double", "n int", step)


def carried(stream: DataFrame, key: str, step_limit: float) -> DataFrame:
    """Outliers replaced by the last accepted value."""

    def step(s, r):
        v = float(r.value) if s is None or abs(float(r.value) - s[0]) <= step_limit else s[0]
        return (v,), [(float(r.t), v)]

    return _stateful(stream, key, f"{key} long, t double, value double", "last double", step)


def dead_reckoned(stream: DataFrame, key: str, gap: float = 0.1) -> DataFrame:
    """Speed and shift; a gap, or a row with `reset` true, begins anew."""

    def step(s, r):
        if s is None or r.t - s[0] >= gap or bool(getattr(r, "reset", False)):
            s = (float(r.t), 0.0, 0.0)
        else:
            dt, a = float(r.t) - s[0], float(r.value)
            s = (float(r.t), s[1] + a * dt, s[2] + s[1] * dt + a * dt * dt / 2)
        return s, [s]

    return _stateful(stream, key, f"{key} long, t double, speed double, shift double", "t double, v double, s double", step)


def merged_instances(stream: DataFrame, key: str, reach: float, ttl: float) -> DataFrame:
    """Instances (x, y, t) of a map by their centres (instance_map.instance_stream has outlines): each joins the nearest known one within reach, else is new; those
    unseen for ttl seconds of event time are evicted. Emits (key, t, instance, n)."""

    def step(s, r):
        known = [list(v) for v in zip(*s[:5])] if s is not None else []
        nxt = s[5] if s is not None else 0
        known = [v for v in known if r.t - v[3] < ttl]
        near = min(known, key=lambda v: ((v[1] - r.x) ** 2 + (v[2] - r.y) ** 2, v[0]), default=None)
        if near is None or (near[1] - r.x) ** 2 + (near[2] - r.y) ** 2 > reach**2:
            near = [nxt, float(r.x), float(r.y), float(r.t), 0]
            known.append(near)
            nxt += 1
        n = near[4] + 1
        near[1:] = [(near[1] * near[4] + r.x) / n, (near[2] * near[4] + r.y) / n, float(r.t), n]
        cols = [list(c) for c in zip(*known)]
        return (*cols, nxt), [(float(r.t), near[0], n)]

    state = "id array<long>, x array<double>, y array<double>, t array<double>, n array<long>, next long"
    return _stateful(stream, key, f"{key} long, t double, instance long, n long", state, step)
