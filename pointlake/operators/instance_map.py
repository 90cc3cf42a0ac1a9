"""Maps of instances from frames of outlines.

A frame is a time and outlines (id, points). In order: outlines of a frame that overlap become one (their hull's union, the smallest id).
The first frame's go to the map. Later ones are matched one to one, at the least sum of centre distances, with map instances no
farther than `match`, those left over with temporary instances, and those left over again become temporary (negative ids). A match with
the map grows that instance; a match with a temporary one moves it to the map under a new id. Map instances that grew or came in and share
more than `share` of the smaller outline become one, the smaller id stays, until none do. Temporary instances unseen for more
than `ttl` seconds go. `tiers` 2 matches temporary instances only after the map's; 3 matches them first (the other order of stages).

A map depends on all frames before, so a map (key) is one pass; maps are independent. Batch and stream run the same step.
A null or empty frame only moves time on. An outline with fewer than three corners never overlaps but has a centre and can match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pointlake.functions.polygon import area, hull, intersection
from pointlake.operators.cluster import hungarian


@dataclass
class Instance:
    outline: np.ndarray
    n: int
    t: float

    def centre(self) -> np.ndarray:
        return self.outline.mean(0)

    def grown(self, o: Instance) -> Instance:
        return Instance(hull(np.vstack([self.outline, o.outline])), self.n + o.n, max(self.t, o.t))


@dataclass
class Rules:
    match: float = 1.0
    share: float = 0.2
    ttl: float = 5.0
    tiers: int = 2


@dataclass
class Map:
    """known: instances by id, negative ones temporary; the next id of each kind."""

    known: dict[int, Instance] = field(default_factory=dict)
    next: int = 0
    low: int = -1


def overlap_share(a: np.ndarray, b: np.ndarray) -> float:
    """Common area as a share of the smaller outline; 0 where one has no area."""
    if len(a) < 3 or len(b) < 3 or (a.min(0) >= b.max(0)).any() or (b.min(0) >= a.max(0)).any():
        return 0.0
    least = min(area(a), area(b))
    return area(intersection(a, b)) / least if least else 0.0


def united(items: dict[int, Instance], share: float) -> tuple[dict[int, Instance], dict[int, int]]:
    """Items that share more than `share` become one, the smaller id, until none do; and where each id that went is now."""
    items, went = dict(items), {}
    again = True
    while again:
        again = False
        ids = sorted(items)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if a in items and b in items and overlap_share(items[a].outline, items[b].outline) > share:
                    items[a] = items[a].grown(items.pop(b))
                    went[b], again = a, True

    def end(i: int) -> int:
        while i in went:
            i = went[i]
        return i

    return items, {i: end(i) for i in went}


def matched(new: dict[int, Instance], known: dict[int, Instance], reach: float) -> dict[int, int]:
    """New ids with the known id each is matched with: as many as possible, then the least sum of centre distances."""
    if not new or not known:
        return {}
    rows, cols = sorted(new), sorted(known)
    a, b = (np.array([s[i].centre() for i in ids]) for s, ids in ((new, rows), (known, cols)))
    cost = np.linalg.norm(a[:, None] - b[None], axis=2)
    far = 1e3 * (reach + 1) * min(cost.shape)
    got = hungarian(np.where(cost <= reach, cost, far))
    return {rows[r]: cols[c] for r, c in enumerate(got) if c >= 0 and cost[r, c] <= reach}


def step(m: Map, t: float, outlines: list[tuple[int, np.ndarray]], rules: Rules) -> list[tuple[int, str, int]]:
    """Takes a frame into the map; (outline id, what became of it, instance) rows, and (id that went, 'merged', instance) ones."""
    new, into = united({int(i): Instance(hull(p), 1, t) for i, p in outlines if len(p)}, 0.0)
    rows, touched = [], set()
    for i in [i for i, v in m.known.items() if i < 0 and t - v.t > rules.ttl]:
        del m.known[i]
    if not m.next and not m.known:
        found = {}
    else:
        on_map, temporary = {i: v for i, v in m.known.items() if i >= 0}, {i: v for i, v in m.known.items() if i < 0}
        found = {}
        for stage in (on_map, temporary) if rules.tiers == 2 else (temporary, on_map):
            found |= matched({i: v for i, v in new.items() if i not in found}, stage, rules.match)
    first = not m.next and not m.known
    where = {}
    for i in sorted(new):
        at = found.get(i)
        if at is None and not first:
            at, kind = m.low, "temporary"
            m.known[at] = new[i]
            m.low -= 1
        elif at is None or at < 0:
            kind = "new" if at is None else "promoted"
            one = new[i] if at is None else m.known.pop(at).grown(new[i])
            at = m.next
            m.known[at] = one
            m.next += 1
            touched.add(at)
        else:
            kind = "map"
            m.known[at] = m.known[at].grown(new[i])
            touched.add(at)
        where[i] = at
        rows.append((i, kind, at))
    rows += [(i, "joined", where[j]) for i, j in sorted(into.items())]
    kept, went = united({i: m.known[i] for i in touched}, rules.share)
    for i in touched:
        m.known.pop(i)
    m.known |= kept
    return rows + [(i, "merged", j) for i, j in sorted(went.items())]


#: A frame's outlines.
OUTLINES = "array<struct<id: bigint, xs: array<double>, ys: array<double>>>"


def _outlines(value) -> list[tuple[int, np.ndarray]]:
    return [(o["id"], np.stack([np.asarray(o["xs"], float), np.asarray(o["ys"], float)], 1)) for o in (value if value is not None else [])]


def instance_map(frames: DataFrame, key: str, rules: Rules | None = None) -> DataFrame:
    """frames (key long, t double, outlines) -> (key, t, id, kind, instance), a map for each key, its frames in order of t."""
    held = rules or Rules()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, rows, k = Map(), [], pdf[key].iloc[0]
        for t, o in zip(*(pdf.sort_values("t", kind="stable")[c] for c in ("t", "outlines"))):
            rows += [(k, t, *r) for r in step(m, float(t), _outlines(o), held)]
        return pd.DataFrame(rows, columns=[key, "t", "id", "kind", "instance"])

    return frames.select(key, "t", "outlines").groupBy(key).applyInPandas(run, f"{key} long, t double, id long, kind string, instance long")


class _Processor(StatefulProcessor):
    """Frames wait for the watermark, then enter the map in order of time; timers also evict temporary instances."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers = ArrayType(DoubleType())
        self.handle = handle
        self.known = handle.getMapState("known", StructType([StructField("id", LongType())]), StructType([StructField("xs", numbers), StructField("ys", numbers), StructField("n", LongType()), StructField("t", DoubleType())]))
        self.ids = handle.getValueState("ids", StructType([StructField("next", LongType()), StructField("low", LongType())]))
        self.waiting = handle.getMapState("waiting", StructType([StructField("ms", LongType()), StructField("turn", LongType())]), StructType([StructField("t", DoubleType()), StructField("ids", ArrayType(LongType())), StructField("sizes", ArrayType(LongType())), StructField("xs", numbers), StructField("ys", numbers)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn = sum(1 for _ in self.waiting.keys())
        for pdf in rows:
            for ms, t, *frame in zip(pdf["ms"], pdf["t"], pdf["ids"], pdf["sizes"], pdf["xs"], pdf["ys"]):
                self.waiting.updateValue((int(ms), turn), (float(t), *(np.asarray(v).tolist() for v in frame)))
                self.handle.registerTimer(int(ms))
                turn += 1
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted((v[0], *k, v) for k, v in ((tuple(k), tuple(v)) for k, v in self.waiting.iterator()) if k[0] <= expiredTimerInfo.getExpiryTimeInMs())
        if due:
            ids = self.ids.get() if self.ids.exists() else (0, -1)
            m = Map({int(k[0]): Instance(np.stack([np.asarray(v[0], float), np.asarray(v[1], float)], 1), int(v[2]), float(v[3])) for k, v in self.known.iterator()}, int(ids[0]), int(ids[1]))
            before, out = set(m.known), []
            for t, ms, turn, (_, oids, sizes, xs, ys) in due:
                cut = np.cumsum([0, *sizes])
                p = np.stack([np.asarray(xs, float), np.asarray(ys, float)], 1).reshape(-1, 2)
                out += [(key[0], t, *r) for r in step(m, t, [(i, p[a:b]) for i, a, b in zip(oids, cut, cut[1:])], self.rules)]
                self.waiting.removeKey((ms, turn))
            for i in before - set(m.known):
                self.known.removeKey((i,))
            for i, v in m.known.items():
                self.known.updateValue((i,), (v.outline[:, 0].tolist(), v.outline[:, 1].tolist(), v.n, v.t))
            self.ids.update((m.next, m.low))
            if out:
                yield pd.DataFrame(out, columns=["key", "t", "id", "kind", "instance"])
                return
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def instance_stream(frames: DataFrame, key: str, delay: str, rules: Rules | None = None) -> DataFrame:
    """The same over a stream of frames (key long, ts timestamp, t double, outlines): (key, t, id, kind, instance). Frames up to `delay` late
    still enter in order of time; later ones are dropped by the watermark. State ends a frame's wait once it has entered."""
    o = F.coalesce("outlines", F.array().cast(OUTLINES))
    flat = [o["id"].alias("ids"), F.transform(o, lambda v: F.size(v["xs"]).cast("long")).alias("sizes"), *[F.flatten(o[c]).alias(c) for c in ("xs", "ys")]]
    seen = frames.withWatermark("ts", delay).select(key, "ts", F.unix_millis("ts").alias("ms"), "t", *flat)
    return seen.groupBy(key).transformWithStateInPandas(_Processor(rules or Rules()), "key long, t double, id long, kind string, instance long", "append", "eventTime")
