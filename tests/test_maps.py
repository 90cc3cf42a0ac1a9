"""Maps and poses against plain versions: running products over several blocks, lateral search, instance maps in batch and on a stream."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.functions import descriptor
from pointlake.operators import instance_map as im
from pointlake.operators import cluster, lateral, posegraph, registration, scan, windows
from pointlake.plans import maps
from pointlake.streaming import streams

DATA = "/root/testdata/sf0.001"


# ---- running products ----


@pytest.mark.parametrize("left", [False, True])
def test_products_over_blocks(spark, left):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, n in (("a", 700), ("b", 1), (None, 130), ("c", 64), ("d", 2)):
        now = np.eye(4)
        for i in range(n):
            q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
            m = np.eye(4)
            m[:3, :3], m[:3, 3] = q * np.sign(np.linalg.det(q)), rng.normal(size=3)
            now = m @ now if left else now @ m
            rows.append((key, i, "clash", *m[:3].ravel().tolist()))
            want[key, i] = now[:3].ravel()
    df = spark.createDataFrame(rows, "k string, i long, _n string, " + ", ".join(f"{n} double" for n in windows.POSE)).repartition(3, "i")
    out = windows.pose_product(df, ["k"], ["i"], left, parts=9)
    assert out.columns == df.columns and out.count() == len(rows)
    for r in out.collect():
        assert np.allclose([r[n] for n in windows.POSE], want[r["k"], r["i"]], atol=1e-9), r
    assert windows.pose_product(df.where("i < 0"), ["k"], ["i"], left).count() == 0


def test_scan_of_segments():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 5, (5000, 1)).astype(float)
    first = np.array([0, 1, 2, 70, 71, 4500])
    got = scan.scanned(np.log(x), first, np.add)  # a sum stands for any product
    for a, b in zip(first, [*first[1:], len(x)]):
        assert np.allclose(got[a:b], np.cumsum(np.log(x[a:b]), 0))


# ---- lateral search ----


def _plain_descriptor(points, shift, rings, sectors, reach):
    d = np.zeros((rings, sectors))
    seen = np.zeros_like(d, bool)
    for x, y, z in points:
        y = y + shift
        r = math.hypot(x, y)
        if r > reach:
            continue
        a = (math.degrees(math.atan2(y or 0.001, x or 0.001)) + 360) % 360
        i, j = max(min(math.ceil(r / reach * rings), rings), 1) - 1, max(min(math.ceil(a / 360 * sectors), sectors), 1) - 1
        d[i, j] = max(d[i, j], z + 2) if seen[i, j] else z + 2
        seen[i, j] = True
    return d


def _plain_distance(old, new):
    n = old.shape[1]
    gaps = [np.linalg.norm(old.mean(0) - np.roll(new.mean(0), k)) for k in range(n)]
    new = np.roll(new, int(np.argmin(gaps)), 1)
    cos = [a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a, b in zip(old.T, new.T) if a.any() and b.any()]
    return 1 - np.mean(cos) if cos else None


def _plain_search(new, old, visited):
    """The rule as a loop over shifts that stops at the first acceptable one."""
    score = lambda s: _plain_distance(_plain_descriptor(old, 0.0, 4, 8, 20.0), _plain_descriptor(new, s, 4, 8, 20.0))
    kept, still = [], None
    for s in lateral.COARSE:
        tries = [(d, k) for k in ({s, -s}) if (d := score(k)) is not None]
        if not tries:
            continue
        d, k = min(tries)
        if s == 0:
            still = d
        if d < lateral.ACCEPT:
            visited.add("coarse")
            return d
        if d < lateral.KEEP:
            kept.append((d, len(kept), k))
    best = []
    for _, _, k in sorted(kept):
        for f in lateral.FINE:
            d = score(k + (-f if k < 0 else f))
            if d is None:
                continue
            if d < lateral.ACCEPT:
                visited.add("fine")
                return d
            best.append(d)
    visited.add("best" if best else "still")
    return min(best, default=still)


def test_lateral_search_as_a_loop(spark):
    points = maps.clouds(spark, DATA)
    clouds = {f: g[["x", "y", "z"]].to_numpy() for f, g in points.toPandas().groupby("frame")}
    ids = sorted(clouds)
    pairs = [(a, b) for a in ids[::3] for b in ids[::7] if a > b][:160] + [(ids[0], ids[0])]
    got = lateral.lateral_scores(spark.createDataFrame(pairs, "id long, id_r long"), points, descriptor.distance(4, 8), 4, 8, 20.0).collect()
    visited: set = set()
    assert len(got) == len(pairs)
    for r in got:
        want = _plain_search(clouds[r["id"]], clouds[r["id_r"]], visited)
        assert (want is None) == (r["score"] is None) and (want is None or abs(want - r["score"]) < 1e-9), r
    assert {"coarse", "fine"} <= visited


def test_lateral_far_cloud_has_no_score(spark):
    points = spark.createDataFrame([(1, 0, 500.0, 0.0, 1.0), (2, 0, 3.0, 1.0, 1.0)], "frame long, pos long, x double, y double, z double")
    got = lateral.lateral_scores(spark.createDataFrame([(1, 2), (2, 1)], "id long, id_r long"), points, descriptor.distance(4, 8), 4, 8, 20.0).collect()
    assert {(r["id"], r["score"], r["shift"], r["fine"]) for r in got} == {(1, None, None, False), (2, None, None, False)}


# ---- instance maps ----


def _clip_area(p, q):
    """Common area of two convex outlines, by cutting p at every edge of q."""
    if any(max(c[k] for c in p) <= min(c[k] for c in q) or max(c[k] for c in q) <= min(c[k] for c in p) for k in (0, 1)):
        return 0.0
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for a, b in zip(q, [*q[1:], q[0]]):
        out = []
        for c, d in zip(p, [*p[1:], p[0]]) if p else []:
            s, t = turn(a, b, c), turn(a, b, d)
            if s >= 0:
                out.append(c)
            if s * t < 0:
                k = s / (s - t)
                out.append((c[0] + k * (d[0] - c[0]), c[1] + k * (d[1] - c[1])))
        p = out
    return abs(sum(c[0] * d[1] - c[1] * d[0] for c, d in zip(p, [*p[1:], p[0]]))) / 2 if len(p) > 2 else 0.0


def _wrap(points):
    """Hull by walking around the points."""
    points = sorted(set(map(tuple, points)))
    at, out = points[0], []
    while True:
        out.append(at)
        to = next(p for p in points if p != at)
        for p in points:
            c = (to[0] - at[0]) * (p[1] - at[1]) - (to[1] - at[1]) * (p[0] - at[0])
            if p != at and (c < -1e-12 or abs(c) <= 1e-12 and math.dist(at, p) > math.dist(at, to)):
                to = p
        at = to
        if at == out[0]:
            return out


def _size(p):
    return _clip_area(p, p)


def _join(items, share):
    went = {}
    while True:
        hit = next(((a, b) for a in sorted(items) for b in sorted(items) if a < b and _clip_area(items[a][0], items[b][0]) > share * min(_size(items[a][0]), _size(items[b][0])) + 1e-15), None)
        if not hit:
            return went
        a, b = hit
        items[a] = (_wrap(items[a][0] + items[b][0]), max(items[a][1], items[b][1]))
        del items[b]
        went = {k: a if v == b else v for k, v in went.items()} | {b: a}


def _plain_map(frames, match, ttl, tiers):
    known, nxt, low, rows = {}, 0, -1, []

    def pair(new, old):
        mid = lambda p: (sum(c[0] for c in p) / len(p), sum(c[1] for c in p) / len(p))
        rows_, cols = sorted(new), sorted(old)
        near = [[j for j in cols if math.dist(mid(new[i][0]), mid(old[j][0])) <= match] for i in rows_]
        best = (0, 0.0, {})

        def go(k, used, cost, got):
            nonlocal best
            if k == len(rows_):
                if (-len(got), cost) < (-best[0], best[1]) or not best[2] and got:
                    best = (len(got), cost, dict(got))
                return
            for j in near[k]:
                if j not in used:
                    go(k + 1, used | {j}, cost + math.dist(mid(new[rows_[k]][0]), mid(old[j][0])), got | {rows_[k]: j})
            go(k + 1, used, cost, got)

        go(0, frozenset(), 0.0, {})
        return best[2]

    for t, outlines in frames:
        new = {i: (_wrap(p), t) for i, p in outlines}
        into = _join(new, 0.0)
        known = {i: v for i, v in known.items() if i >= 0 or t - v[1] <= ttl}
        first, found = nxt == 0 and not known, {}
        for stage in (1, -1) if tiers == 2 else (-1, 1):
            found |= pair({i: v for i, v in new.items() if i not in found}, {j: v for j, v in known.items() if (j >= 0) == (stage > 0)})
        touched, where = set(), {}
        for i in sorted(new):
            at = found.get(i)
            grow = lambda o: (_wrap(o[0] + new[i][0]), t)  # noqa: B023, E731
            if at is None and not first:
                at, kind = low, "temporary"
                known[at], low = new[i], low - 1
            elif at is None:
                at, kind, nxt = nxt, "new", nxt + 1
                known[at] = new[i]
            elif at < 0:
                known[nxt] = grow(known.pop(at))
                at, kind, nxt = nxt, "promoted", nxt + 1
            else:
                known[at], kind = grow(known[at]), "map"
            touched |= {at} if at >= 0 else set()
            where[i] = at
            rows.append((t, i, kind, at))
        rows += [(t, i, "joined", where[j]) for i, j in into.items()]
        part = {i: known.pop(i) for i in touched}
        went = _join(part, 0.2)
        known |= part
        rows += [(t, i, "merged", j) for i, j in went.items()]
    return rows


@pytest.mark.parametrize("tiers", [2, 3])
def test_instance_map_as_a_loop(spark, tiers):
    frames = maps.frames(spark, DATA)
    by = {}
    for r in frames.orderBy("t").collect():
        by.setdefault(r["map"], []).append((r["t"], [(o["id"], list(zip(o["xs"], o["ys"]))) for o in r["outlines"]]))
    want = {(k, *r) for k, f in by.items() for r in _plain_map(f, 1.5, 60.0, tiers)}
    got = im.instance_map(frames, "map", im.Rules(match=1.5, ttl=60.0, tiers=tiers)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {r["kind"] for r in got} >= {"new", "map", "temporary", "promoted", "joined", "merged"}


def test_instance_map_edges(spark):
    df = spark.createDataFrame([(1, 0.0, None), (1, 1.0, [(5, [0.0], [0.0])]), (1, 2.0, [(6, [0.2, 0.2], [0.0, 0.0])]), (1, 3.0, [])], f"k long, t double, outlines {im.OUTLINES}")
    assert [tuple(r) for r in im.instance_map(df, "k").orderBy("t").collect()] == [(1, 1.0, 5, "new", 0), (1, 2.0, 6, "map", 0)]
    assert im.instance_map(df.where("t > 9"), "k").count() == 0


def test_matching_is_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ({i: im.Instance(rng.normal(size=(1, 2)), 1, 0.0) for i in range(n)} for n in rng.integers(1, 6, 2))
        got = im.matched(a, b, 1.0)
        cost = lambda m: sum(math.dist(a[i].outline[0], b[j].outline[0]) for i, j in m.items())  # noqa: B023, E731
        best = (0, 0.0)
        wide, narrow = (b, a) if len(b) >= len(a) else (a, b)
        for p in permutations(wide, len(narrow)):
            m = {i: j for i, j in zip(narrow, p)} if narrow is a else {i: j for j, i in zip(narrow, p)}
            m = {i: j for i, j in m.items() if math.dist(a[i].outline[0], b[j].outline[0]) <= 1.0}
            best = min(best, (-len(m), cost(m)))
        assert (-len(got), pytest.approx(cost(got))) == best


def test_instance_stream_with_disorder_and_late_frames(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        frames = maps.frames(spark, DATA).where("map < 3").withColumn("ts", F.timestamp_seconds(F.col("t")))
        pdf = frames.toPandas().sort_values("t").reset_index(drop=True)
        pdf["turn"] = pdf.index // 30
        swapped = pdf.copy()
        swapped.loc[:, "batch"] = [b + 1 if i % 5 == 0 and b < 1 else b for i, b in enumerate(pdf["turn"])]  # some come a batch later
        made = lambda rows: spark.createDataFrame(rows, f"map long, t double, outlines {im.OUTLINES}").withColumn("ts", F.timestamp_seconds("t"))
        late, end = made([(0, 1.5, [(9, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])])]), made([(k, 1e6, None) for k in range(3)])
        source, schema = str(tmp_path / "in"), frames.select("map", "t", "outlines", "ts").schema
        parts = [frames.where(F.col("t").isin([float(t) for t in g["t"]])) for _, g in swapped.groupby("batch")]
        (tmp_path / "in").mkdir()
        stream = im.instance_stream(spark.readStream.schema(schema).parquet(source), "map", "150 seconds", im.Rules(match=1.5, ttl=60.0))

        def advance():
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(120)

        for part in [*parts, end, late, end.withColumn("ts", F.timestamp_seconds(F.lit(2e6)))]:  # the query starts again each time
            part.select("map", "t", "outlines", "ts").coalesce(1).write.mode("append").parquet(source)
            advance()
        got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        want = {tuple(r) for r in im.instance_map(frames, "map", im.Rules(match=1.5, ttl=60.0)).collect()}
        assert got == want and len(want) > 50
    finally:
        spark.conf.unset(key)


# ---- registration and pose graphs ----


def _rot(w):
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    return np.eye(3) if a < 1e-15 else np.eye(3) + math.sin(a) / a * k + (1 - math.cos(a)) / a**2 * k @ k


def _log(r):
    a = math.acos(max(-1.0, min(1.0, (np.trace(r) - 1) / 2)))
    v = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return v / 2 if a < 1e-8 else v * a / (2 * math.sin(a))


def _plain_gicp(src, dst, k, reach, eps, c, rounds):
    """Points (label, x, y, z) against points, by dense matrices and a numeric derivative of the weighted residual's moved points."""

    def cov(points):
        out = []
        for p in points:
            own = points[points[:, 0] == p[0], 1:]
            near = own[np.argsort(((own - p[1:]) ** 2).sum(1), kind="stable")[:k]]
            u, _, vt = np.linalg.svd(np.cov(near.T, bias=True))
            out.append(u @ np.diag([1, 1, eps]) @ vt)
        return out

    cs, cd, r, t = cov(src), cov(dst), np.eye(3), np.zeros(3)
    for _ in range(rounds):
        h, g = np.zeros((6, 6)), np.zeros(6)
        for p, c1 in zip(src, cs):
            m = r @ p[1:] + t
            same = [(((m - q[1:]) ** 2).sum(), i) for i, q in enumerate(dst) if q[0] == p[0]]
            d2, i = min(same)
            if d2 > reach**2:
                continue
            d, w = m - dst[i, 1:], np.linalg.inv(cd[i] + r @ c1 @ r.T)
            w = w / (1 + d @ w @ d / c**2)
            j = np.hstack([np.array([[0, m[2], -m[1]], [-m[2], 0, m[0]], [m[1], -m[0], 0]]), np.eye(3)])
            h, g = h + j.T @ w @ j, g + j.T @ w @ d
        step = -np.linalg.solve(h, g)
        r, t = _rot(step[:3]) @ r, _rot(step[:3]) @ t + step[3:]
    return np.hstack([r, t[:, None]])


def test_registration_against_plain_rounds(spark):
    rng = np.random.default_rng(5)
    src = {p: np.column_stack([np.arange(40) % 2, rng.normal(size=(40, 3)) * [6, 6, 2]]) for p in range(3)}
    dst = {p: np.column_stack([v[:, 0], v[:, 1:] @ _rot(np.array([0.02, -0.03, 0.05])).T + [0.3, -0.2, 0.1] + rng.normal(size=(40, 3)) * 0.05]) for p, v in src.items()}
    table = lambda clouds: spark.createDataFrame([(p, int(v[0]), i, *map(float, v[1:])) for p, c in clouds.items() for i, v in enumerate(c)], "pair long, label long, pos long, x double, y double, z double")
    lonely = spark.createDataFrame([(9, 0, 0, 0.0, 0.0, 0.0)], "pair long, label long, pos long, x double, y double, z double")
    got = registration.registered(table(src).unionByName(lonely), table(dst), ["pair"], k=8, reach=3.0, around=40.0, rounds=4, settle=0.0).collect()
    for r in got:
        pose = np.array([r[n] for n in windows.POSE]).reshape(3, 4)
        if r["pair"] == 9:
            assert np.allclose(pose, np.eye(3, 4)) and r["n"] == 0 and r["mse"] is None
        else:
            assert np.allclose(pose, _plain_gicp(src[r["pair"]], dst[r["pair"]], 8, 3.0, 0.001, 1.5, 4), atol=1e-8) and r["n"] == 40
    assert len(got) == 4


def test_small_clouds_need_no_plan_of_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = lambda move: [(p, i % 2, i, *[float(v) for v in at + move]) for p, at0 in clouds.items() for i, at in enumerate(at0)]
    clouds = {p: np.vstack([a := rng.normal(size=(30, 3)) * [6, 6, 2], a[:2]]) for p in range(3)}  # two points twice: equal distances
    shape = "pair long, label long, pos long, x double, y double, z double"
    odd = [(0, 0, 90, None, 0.0, 0.0), (0, None, 91, 0.0, 0.0, 0.0), (None, 0, 92, 0.0, 0.0, 0.0), (7, 0, 0, 0.0, 0.0, 0.0), (1, 1, 93, float("nan"), 0.0, 0.0)]
    src, dst = spark.createDataFrame(rows(0.0) + odd, shape), spark.createDataFrame(rows(np.array([0.2, -0.1, 0.05])) + odd[:3], shape)
    solve = lambda small: {r["pair"]: r for r in registration.registered(src, dst, ["pair"], k=8, reach=3.0, around=40.0, rounds=4, settle=0.0, small=small).collect()}
    rounds, mixed = solve(0), solve(31)
    monkeypatch.setattr(registration, "knn", None)  # what the rounds in tables are made of
    whole = solve(64)
    assert rounds.keys() == mixed.keys() == whole.keys() == {0, 1, 2, 7}
    for p, r in rounds.items():
        for other in (mixed[p], whole[p]):
            assert np.allclose([r[n] for n in windows.POSE], [other[n] for n in windows.POSE], atol=1e-8) and r["n"] == other["n"]
            assert (r["mse"] is None) == (other["mse"] is None) and (r["mse"] is None or abs(r["mse"] - other["mse"]) < 1e-8)


def _plain_graph(poses, factors, rounds=12):
    """Dense Gauss-Newton with numeric derivatives; poses id -> (R, t)."""
    ids = sorted(poses)

    def residual(p):
        out = []
        for i, j, rz, tz, wt, wr in factors:
            ri, ti = p[i] if i is not None else (np.eye(3), np.zeros(3))
            rj, tj = p[j]
            out += [math.sqrt(wt) * rz.T @ (ri.T @ (tj - ti) - tz), math.sqrt(wr) * _log(rz.T @ ri.T @ rj)]
        return np.concatenate(out)

    def moved(p, x):
        return {n: (p[n][0] @ _rot(x[6 * k + 3 : 6 * k + 6]), p[n][1] + p[n][0] @ x[6 * k : 6 * k + 3]) for k, n in enumerate(ids)}

    for _ in range(rounds):
        j = np.stack([(residual(moved(poses, e * 1e-6)) - residual(moved(poses, -e * 1e-6))) / 2e-6 for e in np.eye(6 * len(ids))], 1)
        poses = moved(poses, -np.linalg.lstsq(j, residual(poses), rcond=None)[0])
    return poses


@pytest.mark.parametrize("small", [0, 64])
def test_pose_graph_against_dense_steps(spark, small):
    rng = np.random.default_rng(6)
    nodes, factors, want = [], [], {}
    for g in range(2):
        true = {i: (_rot(rng.normal(size=3) * 0.4), rng.normal(size=3) * 2) for i in range(3)}
        made = []
        for i, j in ((0, 1), (1, 2), (2, 0), (None, 0), (None, 2)):
            ri, ti = true[i] if i is not None else (np.eye(3), np.zeros(3))
            made.append((i, j, ri.T @ true[j][0] @ _rot(rng.normal(size=3) * 0.03), ri.T @ (true[j][1] - ti) + rng.normal(size=3) * 0.05, 1.0, 0.0 if (i, j) == (None, 2) else 2.0))
        start = {i: (r @ _rot(rng.normal(size=3) * 0.1), t + rng.normal(size=3) * 0.1) for i, (r, t) in true.items()}
        nodes += [(g, i, *np.hstack([r, t[:, None]]).ravel().tolist()) for i, (r, t) in start.items()]
        factors += [(g, i, j, *np.hstack([r, t[:, None]]).ravel().tolist(), a, b) for i, j, r, t, a, b in made]
        want |= {(g, i): np.hstack([r, t[:, None]]) for i, (r, t) in _plain_graph(start, made).items()}
    nodes.append((5, 0, *np.eye(3, 4).ravel().tolist()))  # without factors
    factors.append((0, 7, 1, *np.eye(3, 4).ravel().tolist(), 1.0, 1.0))  # of a node that isn't there
    cols = lambda names: ", ".join(f"{n} double" for n in names)
    out = posegraph.optimised(
        spark.createDataFrame(nodes, f"graph long, id long, {cols(windows.POSE)}"), spark.createDataFrame(factors, f"graph long, i long, j long, {cols(posegraph.MEASURED)}, wt double, wr double"),
        rounds=4, tolerance=1e-4, settle=1e-3, small=small,
    ).collect()
    assert len(out) == 7
    for r in out:
        pose = np.array([r[n] for n in windows.POSE]).reshape(3, 4)
        assert np.allclose(pose, want.get((r["graph"], r["id"]), np.eye(3, 4)), atol=2e-4), r


def test_overlaps_to_the_fixpoint(spark):
    got = {(r["map"], r["id"]): (r["instance"], r["n"]) for r in maps.overlap_merge(spark, DATA).collect()}
    by = {}
    for r in maps.frames(spark, DATA).collect():
        for o in r["outlines"]:
            by.setdefault(r["map"], {})[int(r["t"]) * 4 + o["id"]] = (_wrap(list(zip(o["xs"], o["ys"]))), 0)
    for k, items in by.items():
        ids = set(items)
        went = _join(items, 0.0)
        to = {i: went.get(i, i) for i in ids}
        assert {i: got[k, i] for i in ids} == {i: (to[i], sum(v == to[i] for v in to.values())) for i in ids}
    odd = spark.createDataFrame([(1, 1, None), (1, 2, []), (1, 3, [(0.0, 0.0), (1.0, 1.0)]), (1, 4, [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)])], f"map long, id long, outline {cluster.XY}")
    members, made = cluster.overlap_fixpoint(odd, ["map"], 1.0)
    assert {(r["id"], r["instance"]) for r in members.collect()} == {(i, i) for i in range(1, 5)} and made.count() == 4


def test_a_crowd_is_joined_without_its_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    box = lambda x, y, w, h: [(float(x - w), float(y - h)), (float(x + w), float(y - h)), (float(x + w), float(y + h)), (float(x - w), float(y + h))]
    at = np.vstack([rng.normal(size=(200, 2)), rng.uniform(-30, 30, size=(40, 2))])
    rows = [(i % 2 + 1, i, box(*p, *rng.uniform(0.2, 1.5, 2))) for i, p in enumerate(at)]
    rows += [(None, 900, box(0, 0, 1, 1)), (None, 901, box(0, 0, 1, 1)), (1, 902, None), (1, 903, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)])]
    sizes, plain = [], cluster._overlapping
    monkeypatch.setattr(cluster, "_overlapping", lambda items, *a: sizes.append(items.count()) or plain(items, *a))
    members, _ = cluster.overlap_fixpoint(spark.createDataFrame(rows, f"map long, id long, outline {cluster.XY}"), ["map"], 2.0)
    got = {r["id"]: r["instance"] for r in members.collect()}
    assert sizes[0] < 100
    for k in (1, 2):
        items = {i: (_wrap(o), 0) for m, i, o in rows if m == k and i < 900}
        ids = set(items)
        went = _join(items, 0.0)
        assert {i: got[i] for i in ids} == {i: went.get(i, i) for i in ids}
    assert {i: got[i] for i in (900, 901, 902, 903)} == {900: 900, 901: 901, 902: 902, 903: 903}


# ---- aligned streams ----


def _run_stream(spark, tmp_path, batches, n, strict):
    """Files of each batch become rows of n streams (k, stamp, v); the query starts again for each batch."""
    schema, sources = "k long, stamp timestamp, v long", [tmp_path / f"in{i}" for i in range(n)]
    for s in sources:
        s.mkdir()
    out = streams.aligned([spark.readStream.schema(schema).parquet(str(s)) for s in sources], ["k"], delay="10 seconds", strict=strict)
    for batch in batches:
        for i, rows in enumerate(batch):
            spark.createDataFrame(rows, "k long, s long, v long").select("k", F.timestamp_seconds("s").alias("stamp"), "v").coalesce(1).write.mode("append").parquet(str(sources[i]))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(90)
    return sorted((r["k"], int(r["stamp"].timestamp()), r["s0"]["v"], r["s1"]["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_aligned_streams_wait_and_drop_late_rows(spark, tmp_path):
    first = [[(1, 5, 50), (1, 20, 51), (2, 20, 7)], [(1, 5, 60), (1, 21, 61)]]  # 20 and 21 lack a partner yet
    later = [[(1, 21, 52), (1, 100, 53)], [(1, 20, 62), (1, 100, 63), (2, 99, 9)]]
    late = [[(1, 6, 70), (1, 300, 1)], [(1, 6, 71), (1, 300, 2)]]  # 6 is behind the watermark
    got = _run_stream(spark, tmp_path, [first, later, late, [[(1, 900, 0)], [(1, 900, 0)]]], 2, False)
    assert got == [(1, 5, 50, 60), (1, 20, 51, 62), (1, 21, 52, 61), (1, 100, 53, 63), (1, 300, 1, 2)]


def test_aligned_streams_strict(spark, tmp_path):
    whole = [[(1, 5, 50), (1, 20, 51)], [(1, 5, 60), (1, 20, 61)]]
    with pytest.raises(Exception, match="lacks the stamp"):
        _run_stream(spark, tmp_path, [whole, [[(1, 100, 1)], [(1, 101, 2)]], [[(1, 900, 0)], [(1, 900, 0)]]], 2, True)
    rows = lambda v: spark.createDataFrame(v, "k long, s long, v long").select("k", F.timestamp_seconds("s").alias("stamp"), "v")
    assert streams.aligned([rows(whole[0]), rows(whole[1])], ["k"], strict=True).count() == 2
    with pytest.raises(Exception, match="lacks the stamp"):
        streams.aligned([rows(whole[0]), rows(whole[1][:1])], ["k"], strict=True).collect()
