"""Registered queries of maps and poses: loop search under shifts, running products, instance maps, graph solves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.functions import descriptor, geometry
from pointlake.operators import instance_map as instances
from pointlake.operators import cluster, lateral, posegraph, registration, windows
from pointlake.plans.catalog import query
from pointlake.session import read, rounded, sensor
from pointlake.streaming import streams

# ---- clouds of 21 points for each embedding ----

CLOUD = """c AS (SELECT vec_id AS id, k, embedding[3 * k + 1]::DOUBLE * 40 AS x, embedding[3 * k + 2]::DOUBLE * 40 AS y, embedding[3 * k + 3]::DOUBLE * 40 AS z FROM embeddings, range(21) r(k))"""


def clouds(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as clouds: frame = vec_id, 21 points of three dimensions each, times 40."""
    e = read(spark, d, "embeddings")
    at = lambda j: F.element_at("embedding", (3 * F.col("pos") + j).cast("int")).cast("double") * 40
    return e.select("embedding", F.col("vec_id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("pos")).select("frame", "pos", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


# ---- loops ----

_STEPS = ", ".join(str(s) for s in sorted({round(k * (s + f), 1) for s in lateral.COARSE for f in (0.0, *lateral.FINE) for k in (1, -1)}))


@query(f"""WITH {CLOUD},
n AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings),
pairs AS (SELECT a.id, b.id AS id_r FROM n a JOIN n b ON a.id - b.id >= 50 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.16),
s AS (SELECT unnest([{_STEPS}])::DOUBLE AS shift),
b AS (SELECT id, shift, greatest(least(ceil(sqrt(x * x + v * v) / 20 * 4), 4), 1)::INTEGER - 1 AS ring,
 greatest(least(ceil(((degrees(atan2(CASE WHEN v = 0 THEN 0.001 ELSE v END, CASE WHEN x = 0 THEN 0.001 ELSE x END)) + 360) % 360) / 360 * 8), 8), 1)::INTEGER - 1 AS sector, max(z + 2) AS h
 FROM (SELECT id, shift, x, y + shift AS v, z FROM c, s) WHERE sqrt(x * x + v * v) <= 20 GROUP BY ALL),
m AS (SELECT id, shift, map_from_entries(list((ring * 8 + sector, h))) AS m FROM b GROUP BY id, shift),
g AS (SELECT id, shift, [coalesce(m[i::INTEGER], 0.0) FOR i IN range(32)] AS d FROM m),
col AS (SELECT id, shift, [[d[j + 8 * r + 1] FOR r IN range(4)] FOR j IN range(8)] AS c, [list_sum([d[j + 8 * r + 1] * d[j + 8 * r + 1] FOR r IN range(4)]) FOR j IN range(8)] AS q, [list_avg([d[j + 8 * r + 1] FOR r IN range(4)]) FOR j IN range(8)] AS a FROM g),
e AS (SELECT p.id, p.id_r, w.shift, k, list_sum([pow(o.a[j + 1] - w.a[(j - k + 8) % 8 + 1], 2) FOR j IN range(8)]) AS gap,
 list_avg(list_filter([CASE WHEN o.q[j + 1] > 0 AND w.q[(j - k + 8) % 8 + 1] > 0 THEN list_dot_product(o.c[j + 1], w.c[(j - k + 8) % 8 + 1]) / (sqrt(o.q[j + 1]) * sqrt(w.q[(j - k + 8) % 8 + 1])) END FOR j IN range(8)], lambda v: v IS NOT NULL)) AS sim
 FROM pairs p JOIN col o ON o.id = p.id_r AND o.shift = 0 JOIN col w ON w.id = p.id, range(8) r(k)),
t0 AS (SELECT id, id_r, shift, min(gap) AS gap FROM e GROUP BY ALL),
t AS (SELECT id, id_r, shift, 1 - arg_min(e.sim, k) AS dist FROM e JOIN t0 USING (id, id_r, shift, gap) GROUP BY id, id_r, shift HAVING dist IS NOT NULL),
side AS (SELECT id, id_r, list_position([0, 3, 2, 1], abs(shift)::INTEGER) AS visit, min((dist, shift)) AS v FROM t WHERE shift IN (0, 3, 2, 1, -1, -2, -3) GROUP BY ALL),
f AS (SELECT id, id_r, min((visit, v[1], v[2])) FILTER (WHERE v[1] < 0.35) AS first, list_sort(list((v[1], visit, v[2])) FILTER (WHERE v[1] < 0.5)) AS kept, max(v[1]) FILTER (WHERE v[2] = 0) AS still FROM side GROUP BY id, id_r),
o AS (SELECT id, id_r, i AS turn, kept[i][3] AS start, j AS step, [0.2, 0.4, 0.6, 0.8][j]::DOUBLE AS inc FROM f, range(1, 8) a(i), range(1, 5) z(j) WHERE first IS NULL AND i <= len(kept)),
u AS (SELECT o.id, o.id_r, turn * 4 + step AS visit, dist, t.shift FROM o JOIN t ON t.id = o.id AND t.id_r = o.id_r AND abs(t.shift - (start + CASE WHEN start < 0 THEN -inc ELSE inc END)) < 1e-6),
l AS (SELECT id, id_r, min((visit, dist, shift)) FILTER (WHERE dist < 0.35) AS hit, min((dist, visit, shift)) AS best FROM u GROUP BY id, id_r),
r AS (SELECT p.id, p.id_r, coalesce(first[2], hit[2], best[1], still) AS score, coalesce(first[3], hit[3], best[3], CASE WHEN still IS NOT NULL THEN 0 END) AS shift, best IS NOT NULL AS fine FROM pairs p LEFT JOIN f USING (id, id_r) LEFT JOIN l USING (id, id_r))
SELECT n.id, id_r, round(score, 6) AS score, round(shift, 1) + 0.0::DOUBLE AS shift, fine, CASE WHEN id_r IS NOT NULL THEN row_number() OVER (PARTITION BY n.id ORDER BY round(score, 6) NULLS LAST, id_r) END::INTEGER AS rank FROM n LEFT JOIN r USING (id)""")
def loop_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Loops of nodes (vec_id) by lateral descriptor distance; nodes without one have nulls"""
    nodes = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("t"), *[(F.col("embedding")[i].cast("double") * 10).alias(c) for i, c in enumerate("xyz")])
    r = lateral.ranked_loops(nodes, clouds(spark, d), descriptor.distance(4, 8), 0.4, 50, digits=6, rings=4, sectors=8, reach=20.0)
    return r.select("id", "id_r", rounded(F.col("score")).alias("score"), rounded(F.col("shift"), 1).alias("shift"), "fine", "rank")


# ---- instances ----


def frames(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as frames of a map (label) at t = vec_id seconds, with four boxes each."""
    at = lambda i: F.col("embedding")[i].cast("double")
    box = []
    for k in range(4):
        x, y, w, h = at(4 * k) * 20, at(4 * k + 1) * 20, F.abs(at(4 * k + 2)) * 8 + 0.2, F.abs(at(4 * k + 3)) * 8 + 0.2
        box.append(F.struct(F.lit(k).cast("long").alias("id"), F.array(x - w, x + w, x + w, x - w).alias("xs"), F.array(y - h, y - h, y + h, y + h).alias("ys")))
    return read(spark, d, "embeddings").select(F.col("label").cast("long").alias("map"), F.col("vec_id").cast("double").alias("t"), F.array(*box).alias("outlines"))


@query()
def instance_map(spark: SparkSession, d: str) -> DataFrame:
    """Outlines matched with the map, then with temporary instances (tests/test_maps.py compares a plain version over whole tables)"""
    return instances.instance_map(frames(spark, d), "map", instances.Rules(match=1.5, ttl=60.0))


@query()
def instance_map_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Temporary instances first"""
    return instances.instance_map(frames(spark, d), "map", instances.Rules(match=1.5, ttl=60.0, tiers=3))


# ---- registration ----

_MOVE = [0.9998000066665778, -0.01999866669333308, 0.0, 0.12, 0.01999866669333308, 0.9998000066665778, 0.0, -0.08, 0.0, 0.0, 1.0, 0.05]


@query("SELECT DISTINCT vec_id AS pair, 0.9998::DOUBLE AS t00, 0.019999::DOUBLE AS t10, 0.12::DOUBLE AS t03, -0.08::DOUBLE AS t13, 0.05::DOUBLE AS t23, 21::BIGINT AS n, 0.0::DOUBLE AS mse FROM embeddings")
def gicp(spark: SparkSession, d: str) -> DataFrame:
    """Each cloud onto itself, turned by 0.02 and moved: every pose has to be found again"""
    source = clouds(spark, d).withColumnRenamed("frame", "pair").withColumn("label", F.col("pos") % 2)
    target = source.select("pair", "label", "pos", *[v.alias(c) for c, v in zip("xyz", geometry.transformed(F.col("x"), F.col("y"), F.col("z"), _MOVE))])
    r = registration.registered(source, target, ["pair"], k=6, reach=8.0, around=60.0)
    return r.select("pair", *[rounded(F.col(c), 6 if c[1] != c[2] or c == "t03" else 4).alias(c) for c in ("t00", "t10", "t03", "t13", "t23")], "n", rounded(F.col("mse"), 6).alias("mse"))


# ---- pose graphs ----


def pose_graph_tables(spark: SparkSession, d: str, shake: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Graphs of four embeddings in a row: poses that are shaken to start from, and exact factors of the true ones: a prior of the first, steps, a loop
    from the last to the first, and a position fix of the last."""
    at = lambda i: F.col("embedding")[i].cast("double")

    def pose(extra: float) -> list[Column]:
        s = lambda i: at(i) * extra
        return geometry.from_euler(at(3) * 10 + s(10), at(4) * 10 + s(11), at(5) * 10 + s(12), s(13), s(14), at(6) * 4 + s(15), lib=F)

    names = windows.POSE
    e = read(spark, d, "embeddings").select((F.col("vec_id") / 4).cast("long").alias("graph"), (F.col("vec_id") % 4).alias("id"), "embedding")
    true = e.select("graph", "id", *[v.alias(n) for n, v in zip(names, pose(0.0))])
    begin = e.select("graph", "id", *[v.alias(n) for n, v in zip(names, pose(shake))])
    other = true.select("graph", F.col("id").alias("j"), *[F.col(n).alias(f"_{n}") for n in names])
    seen = geometry.composed(geometry.inverse([F.col(n) for n in names]), [F.col(f"_{n}") for n in names])
    steps = true.join(other, "graph").where("j = id + 1 OR (j = 0 AND id = 3)").select("graph", F.col("id").alias("i"), "j", *[v.alias(z) for z, v in zip(posegraph.MEASURED, seen)], F.lit(1.0).alias("wt"), F.lit(2.0).alias("wr"))
    priors = true.where("id IN (0, 3)").select("graph", F.lit(None).cast("long").alias("i"), F.col("id").alias("j"), *[F.col(n).alias(z) for n, z in zip(names, posegraph.MEASURED)], F.lit(1.0).alias("wt"), F.when(F.col("id") == 0, 1.0).otherwise(0.0).alias("wr"))
    return begin, steps.unionByName(priors)


@query("""SELECT (vec_id // 4)::BIGINT AS graph, vec_id % 4 AS id, round(embedding[4]::DOUBLE * 10, 4) + 0.0::DOUBLE AS x, round(embedding[5]::DOUBLE * 10, 4) + 0.0::DOUBLE AS y, round(embedding[6]::DOUBLE * 10, 4) + 0.0::DOUBLE AS z,
round(cos(embedding[7]::DOUBLE * 4), 4) + 0.0::DOUBLE AS c, round(sin(embedding[7]::DOUBLE * 4), 4) + 0.0::DOUBLE AS s, 0.0::DOUBLE AS tilt FROM embeddings""")
def pose_graph(spark: SparkSession, d: str) -> DataFrame:
    """Prior, steps, loop and position fix; the shaken poses have to come back to those that the factors were made of"""
    r = posegraph.optimised(*pose_graph_tables(spark, d), tolerance=1e-4, settle=1e-3)
    return r.select("graph", "id", *[rounded(F.col(n), 4).alias(c) for n, c in (("t03", "x"), ("t13", "y"), ("t23", "z"), ("t00", "c"), ("t10", "s"), ("t20", "tilt"))])


# ---- de-skew ----


@query(f"""WITH p AS (SELECT label::BIGINT AS user_id, vec_id AS pos, -atan2(embedding[2]::DOUBLE * 10, embedding[1]::DOUBLE * 10) AS o FROM embeddings),
a AS (SELECT *, first_value(o) OVER w AS s, last_value(o) OVER w + 2 * pi() AS e0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b AS (SELECT *, CASE WHEN e0 - s > 3 * pi() THEN e0 - 2 * pi() WHEN e0 - s < pi() THEN e0 + 2 * pi() ELSE e0 END AS e, CASE WHEN o < s - pi() / 2 THEN o + 2 * pi() WHEN o > s + pi() * 1.5 THEN o - 2 * pi() ELSE o END AS early FROM a),
c AS (SELECT *, CASE WHEN o + 2 * pi() < e - pi() * 1.5 THEN o + 4 * pi() WHEN o + 2 * pi() > e + pi() / 2 THEN o ELSE o + 2 * pi() END AS late,
 coalesce(max((early - s > pi())::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM b),
r AS (SELECT user_id, pos, (CASE WHEN past = 1 THEN late ELSE early END - s) / (e - s) * 400 AS rel FROM c),
i AS (SELECT user_id, t / 3600 - 473352 AS t, any_value(value) AS v, any_value(value / 50) AS yaw FROM (SELECT *, epoch_us(ts) / 1e6 AS t FROM events) GROUP BY ALL),
q AS (SELECT r.*, a.t AS ta, a.v AS va, a.yaw AS ya FROM r ASOF LEFT JOIN i a ON r.user_id = a.user_id AND r.rel >= a.t),
z AS (SELECT q.*, b.t AS tb, b.v AS vb, b.yaw AS yb, (rel - ta) / (b.t - ta) AS u FROM q ASOF LEFT JOIN i b ON q.user_id = b.user_id AND q.rel < b.t)
SELECT user_id, pos, round(rel, 5) + 0.0::DOUBLE AS rel, round(CASE WHEN u IS NULL THEN coalesce(va, vb) ELSE va + (vb - va) * u END, 4) + 0.0::DOUBLE AS v,
round(CASE WHEN u IS NULL THEN coalesce(ya, yb) ELSE ya + (yb - ya - 2 * pi() * round((yb - ya) / (2 * pi()))) * u END, 4) + 0.0::DOUBLE AS yaw FROM z""")
def deskew(spark: SparkSession, d: str) -> DataFrame:
    """Azimuth with half-pass state as time of each point (a scan is a label, its period 400 hours), and the sensor's values at that time between the rows around it"""
    e = read(spark, d, "embeddings").select(F.col("label").cast("long").alias("user_id"), F.col("vec_id").alias("pos"), *[(F.col("embedding")[i].cast("double") * 10).alias(c) for i, c in enumerate("xy")])
    p = windows.scan_time(e, ["user_id"], ["pos"], 400.0).select("user_id", "pos", F.col("rel_time").alias("t"))
    s = sensor(spark, d).select("user_id", (F.col("t") / 3600 - 473352).alias("t"), F.col("value").alias("v"), (F.col("value") / 50).alias("yaw"))
    r = windows.interpolated(p, s, ["user_id"], ["v", "yaw"], 24.0, ("yaw",))
    return r.select("user_id", "pos", rounded(F.col("t"), 5).alias("rel"), rounded(F.col("v"), 4).alias("v"), rounded(F.col("yaw"), 4).alias("yaw"))


# ---- overlaps ----


@query()
def overlap_merge(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of every frame of `frames`, merged within their map until no hulls overlap (tests/test_maps.py has a plain version over whole tables)"""
    f = frames(spark, d).select("map", (F.col("t") * 4).cast("long").alias("first"), F.explode("outlines").alias("o"))
    items = f.select("map", (F.col("first") + F.col("o.id")).alias("id"), F.arrays_zip(F.col("o.xs").alias("x"), F.col("o.ys").alias("y")).alias("outline"))
    members, made = cluster.overlap_fixpoint(items, ["map"], 2.0)
    return members.join(made, ["map", "instance"]).select("map", "id", "instance", "n")


# ---- aligned streams ----


@query("""WITH d AS (SELECT user_id, date_trunc('day', ts) AS stamp, event_type, min(event_id) AS e, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, epoch_us(stamp) AS stamp, min(e) FILTER (WHERE event_type = 'view') AS view, min(e) FILTER (WHERE event_type = 'click') AS click, min(e) FILTER (WHERE event_type = 'signup') AS signup, min(e) FILTER (WHERE event_type = 'error') AS error
FROM d WHERE event_type IN ('view', 'click', 'signup', 'error') GROUP BY user_id, stamp HAVING count(*) = 4""")
def aligned_four(spark: SparkSession, d: str) -> DataFrame:
    """Four streams of events by day; a day counts once all have it"""
    e = read(spark, d, "events").withColumn("stamp", F.date_trunc("day", F.col("ts").cast("timestamp")))
    kinds = ("view", "click", "signup", "error")
    out = streams.aligned([e.where(F.col("event_type") == k).select("user_id", "stamp", "event_id") for k in kinds], ["user_id"])
    return out.select("user_id", F.unix_micros("stamp").alias("stamp"), *[F.col(f"s{i}.event_id").alias(k) for i, k in enumerate(kinds)])


@query("""SELECT user_id, epoch_us(ts) AS stamp, min((event_id, value)) [1] AS event_id, min((event_id, value / 2))[2] AS half FROM events GROUP BY user_id, ts""")
def aligned_strict(spark: SparkSession, d: str) -> DataFrame:
    """Five streams made of the same rows; a stamp that one lacked would fail the query"""
    e = read(spark, d, "events").withColumn("stamp", F.col("ts").cast("timestamp"))
    parts = [e.select("user_id", "stamp", "event_id", (F.col("value") / k).alias("v")) for k in range(1, 6)]
    return streams.aligned(parts, ["user_id"], strict=True).select("user_id", F.unix_micros("stamp").alias("stamp"), F.col("s0.event_id").alias("event_id"), F.col("s1.v").alias("half"))
