"""Near-duplicate documents by SetSketch registers over word shingles.

Words are runs of bytes that are no ASCII white space, A-Z lower-cased; a document's set holds its distinct
five-word shingles (64-bit hashes; with fewer words the whole sequence is the one shingle; without words, or with
null text, the set is empty and linked with nothing). Two documents are linked where 100 * |intersection| >=
75 * |union|.

1. Sketch. Register k is floor(1 - log_b x), cut to 0..Q + 1, where x is the smallest of the set's exponentially
   distributed hashes: registers of a union are the maxima of the registers, and the share of equal registers
   follows the similarity.
2. Classes. Documents with the same set are one class, known by a 128-bit hash of the sorted set; its smallest
   doc_id stands for it, so copies never pair up.
3. Candidates. Bands of ROWS registers; classes that agree in a band share a bucket. Every class in a bucket is
   paired with the bucket's smallest one (a star: linear in the bucket's size) unless both are known to be connected.
   A likelihood-ratio test on the registers (counts of larger, smaller, equal; set sizes known) drops pairs that are
   far below the threshold.
4. Verify. Full shingle sets of both sides are intersected. Links found so far give components. Steps 3 and 4 run
   in two rounds: the first FIRST_BANDS bands connect most of a large group, so the other bands pair only the rest.
5. Rest. In buckets that still hold more than one component, classes outside the bucket's largest component are
   compared with all classes of other components, block against block in numpy: rows are pairs of blocks, never pairs
   of classes. A pair is looked at in the first band in which it agrees; what is plausible is verified in place.
   Pairs inside a component can't change the result. So every pair of classes that shares a bucket is decided:
   linked, or known to be connected, or tested and found apart.

Chance to miss a pair: at similarity 0.75 no band of 24 agrees with probability (1 - 0.75**4)**24 = 1e-4, at 0.85
2e-8. A null doc_id can't be named: such a row takes part in nothing and gets a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm import wordhash
from pointlake.llm.common import arrow, hot_join, scope, table, written
from pointlake.llm.components import components

SHINGLE, PER_CENT = 5, 75
BANDS, ROWS, FIRST_BANDS = 24, 4, 6
BLOCK, BLOCK_BYTES = 256, 2 << 20  # classes of a block and bytes of their sets, about
LEAST_EQUAL = 130  # of 256 registers 192 are equal at similarity 0.75: fewer than 130 with probability 1e-15
M = 256  # the first BANDS * ROWS make the bands, all of them the estimate
BASE, Q, RATE = 1.02, 2046, 1 / 64.0
#: A pair goes if its best likelihood at or above the threshold is this many nats below its best overall (3.7 sigma).
NATS = 7.0
#: Ids that may be broadcast to pick texts; more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(7)
_A, _B = (_rng.integers(0, 2**31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in "ab")


def minima(sh: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The smallest of each text's M hashes (texts x M, uint32); every text has a shingle."""
    low, high = (sh & np.uint64(0xFFFFFFFF)).astype(np.uint32), (sh >> np.uint64(32)).astype(np.uint32)
    out, a, b = np.empty((len(to) - 1, M), np.uint32), np.empty_like(low), np.empty_like(low)
    for k in range(M):
        np.multiply(low, _A[k], out=a)
        np.multiply(high, _B[k], out=b)
        a += b
        np.right_shift(a, 15, out=b)
        a ^= b
        a *= np.uint32(0x2C1B3C6D)
        np.right_shift(a, 12, out=b)
        a ^= b
        out[:, k] = np.minimum.reduceat(a, to[:-1])
    return out


def registers(smallest: np.ndarray) -> np.ndarray:
    x = -np.log1p(-(smallest + 0.5) / 2.0**32) * RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype("<u2")


def _sketch(batch: pa.RecordBatch):
    sh, to = wordhash.shingles(*wordhash.words(batch.column(1)), SHINGLE)
    full = np.flatnonzero(np.diff(to) > 0)
    n, keys, regs = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
    if len(full):
        own = registers(minima(sh, np.append(to[:-1][full], to[-1])))
        for j, i in enumerate(full):
            distinct = np.unique(sh[to[i] : to[i + 1]])
            n[i], keys[i], regs[i] = len(distinct), wordhash.digest16(distinct), own[j].tobytes()
    return {"doc_id": batch.column(0), "n": n, "set_id": keys, "regs": regs}


def _sets(batch: pa.RecordBatch):
    sh, to = wordhash.shingles(*wordhash.words(batch.column(1)), SHINGLE)
    items = [np.unique(sh[to[i] : to[i + 1]]) for i in range(batch.num_rows)]
    return {"doc_id": batch.column(0), "set_id": [wordhash.digest16(x) for x in items], "items": [x.tobytes() for x in items]}


def _log_p(share: np.ndarray) -> np.ndarray:
    return -np.log1p(-share * (BASE - 1) / BASE) / np.log(BASE)


def likelihoods(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log-likelihood (pairs x grid) of similarities from the counts of larger, smaller and equal registers."""
    more, less = (regs_a > regs_b).sum(1)[:, None], (regs_a < regs_b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    j = np.minimum(grid[None, :], np.minimum(u / (1 - u), (1 - u) / u))
    p_more, p_less = _log_p(np.maximum(u - (1 - u) * j, 0)), _log_p(np.maximum(1 - u - u * j, 0))
    tiny = 1e-9
    return more * np.log(p_more + tiny) + less * np.log(p_less + tiny) + (M - more - less) * np.log(np.maximum(1 - p_more - p_less, tiny))


_GRID = np.linspace(0, 1, 101)


def _plausible(batch: pa.RecordBatch):
    n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
    regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, M) for i in (4, 5)]
    level = likelihoods(*regs, n_a, n_b, _GRID)
    high = level[:, _GRID * 100 >= PER_CENT - 1e-6].max(1)
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    keep = np.flatnonzero((high >= level.max(1) - NATS) & (100 * small >= PER_CENT * large))
    return {"a": batch.column(0).take(pa.array(keep)), "b": batch.column(1).take(pa.array(keep))} if len(keep) else None


def _is_link(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PER_CENT * (len(a) + len(b) - common)


def _linked(batch: pa.RecordBatch):
    keep = [i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if _is_link(x, y)]
    return {"a": batch.column(0).take(pa.array(keep)), "b": batch.column(1).take(pa.array(keep))} if keep else None


def _texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, items): the full shingle sets of the documents of ids (doc_id)."""
    ids = written(ids.distinct())
    picked = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    return written(arrow(picked, _sets, "doc_id long, set_id binary, items binary"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) of class ids -> the links among them."""
    side = lambda c: classes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    with_regs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    left = written(arrow(with_regs, _plausible, "a long, b long"))
    sets = _texts(left.select(F.col("a").alias("doc_id")).union(left.select("b")), docs)
    full = lambda c: sets.select(F.col("doc_id").alias(c), F.col("items").alias(f"items_{c}"))
    return written(arrow(left.join(full("a"), "a").join(full("b"), "b").select("a", "b", "items_a", "items_b"), _linked, "a long, b long"))


def _block_links(batch: pa.RecordBatch):
    """Links between two blocks of classes of one bucket, other than within a component."""
    found: list[tuple[int, int]] = []
    for band, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
        (ids_a, comp_a, n_a, _), (ids_b, comp_b, n_b, main_b) = ([side.values.field(k).to_numpy(zero_copy_only=False) for k in ("doc_id", "comp", "n", "in_main")] for side in (left, right))
        (regs_a, sets_a), (regs_b, sets_b) = ((np.frombuffer(b"".join(side.values.field("regs").to_pylist()), "<u2").reshape(-1, M), side.values.field("items").to_pylist()) for side in (left, right))
        for at in range(0, len(ids_a), 64):
            part = slice(at, at + 64)
            small, large = np.minimum(n_a[part, None], n_b[None, :]), np.maximum(n_a[part, None], n_b[None, :])
            ok = (comp_a[part, None] != comp_b[None, :]) & (100 * small >= PER_CENT * large)
            ok &= main_b[None, :] | (ids_a[part, None] < ids_b[None, :])  # two classes outside the main component meet twice
            i, j = np.nonzero(ok)
            equal = regs_a[part][i] == regs_b[j]
            first = equal[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(2).argmax(1)
            sure = np.flatnonzero((equal.sum(1) >= LEAST_EQUAL) & (first == band))
            if not len(sure):
                continue
            i, j = i[sure] + at, j[sure]
            level = likelihoods(regs_a[i], regs_b[j], n_a[i].astype(float), n_b[j].astype(float), _GRID)
            keep = level[:, _GRID * 100 >= PER_CENT - 1e-6].max(1) >= level.max(1) - NATS
            found += [(ids_a[x], ids_b[y]) for x, y in zip(i[keep], j[keep]) if _is_link(sets_a[x], sets_b[y])]
    return {"a": [x for x, _ in found], "b": [y for _, y in found]} if found else None


def _in_blocks(open_rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of each bucket's classes outside its main component with all others.

    A bucket's classes are dealt by hash into blocks of about BLOCK classes or BLOCK_BYTES of sets; pairs of blocks are
    rows, and numpy compares them. So a passage that very many documents share makes few rows.
    """
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).alias("_blocks")
    counts = open_rows.groupBy("key").agg(blocks)
    full = classes.select("doc_id", "set_id", "regs").join(_texts(open_rows.select("doc_id"), docs), ["doc_id", "set_id"])
    dealt = open_rows.join(counts, "key").join(full, "doc_id")
    row = F.struct("doc_id", "comp", "n", "regs", "items", (F.col("comp") == F.col("main")).alias("in_main")).alias("row")
    dealt = dealt.select("key", "band", F.pmod(F.xxhash64("doc_id"), "_blocks").alias("block"), row)
    side = lambda df, name: df.groupBy("key", "band", "block").agg(F.collect_list("row").alias(name)).drop("block")
    both = side(dealt.where("NOT row.in_main"), "left").join(side(dealt, "right").drop("band"), "key")
    return written(arrow(both.select("band", "left", "right"), _block_links, "a long, b long").distinct())


def _band_keys(classes: DataFrame) -> DataFrame:
    """(doc_id, n, keys): the bucket of every class in each band."""
    band = lambda i: F.xxhash64(F.lit(i), F.expr(f"substring(regs, {1 + 2 * ROWS * i}, {2 * ROWS})"))
    return classes.select("doc_id", "n", F.array(*[band(i) for i in range(BANDS)]).alias("keys"))


def _buckets(keyed: DataFrame, found: DataFrame | None, bands: range) -> DataFrame:
    """(band, key, doc_id, n, comp): the bucket of every class in each of the bands (counted from the first of them), with
    the component known so far."""
    own = keyed.select("doc_id", "n", F.slice("keys", bands.start + 1, len(bands)).alias("keys"))
    if found is None:
        named = own.withColumn("comp", F.col("doc_id"))
    else:
        names = found.select(F.col("node").alias("doc_id"), "component")
        named = own.join(names, "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("comp"), "keys")
    return named.select("doc_id", "n", "comp", F.posexplode("keys").alias("band", "key"))


def _stars(rows: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of each bucket's smallest class with the classes that are not known to be connected with it."""
    hubs = rows.groupBy("key").agg(F.min(F.struct("doc_id", "comp")).alias("hub"), F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count("*").alias("_k"))
    hubs = written(hubs.where("_low < _high").select("key", F.col("hub.doc_id").alias("a"), F.col("hub.comp").alias("_comp"), "_k"))
    apart = hot_join(rows, hubs, ["key"], "_k", total).where("comp <> _comp")
    return apart.select("a", F.col("doc_id").alias("b")).distinct()


def _open(rows: DataFrame, total: int) -> DataFrame:
    """(key, band, doc_id, n, comp, main) of the buckets that still hold more than one component, without each bucket's
    smallest class, which the stars have decided; main is the largest component."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first"))
    mixed = sizes.groupBy("key").agg(F.max_by("comp", F.struct("_n", "comp")).alias("main"), F.min("_first").alias("hub"), F.count("*").alias("_k"), F.sum("_n").alias("_rows"))
    mixed = written(mixed.where("_k > 1").select("key", "main", "hub", "_rows"))
    return written(hot_join(rows, mixed, ["key"], "_rows", total).where("doc_id <> hub").select("key", "band", "doc_id", "n", "comp", "main"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_shingles, component_id), a row for every row of docs."""
    with scope() as keep:
        sketch, firsts, final = _classes(docs.select("doc_id", "text"))
        keep(sketch, firsts, final)
    by_class = firsts.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    return sketch.join(by_class, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (doc_id, n, set_id, regs) of all rows, (set_id, rep) of classes, (node, component) of classes with links."""
    sketch = written(arrow(docs, _sketch, "doc_id long, n long, set_id binary, regs binary"))
    firsts = sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    firsts = written(firsts)
    classes = written(sketch.join(firsts.select(F.col("rep").alias("doc_id"), "set_id"), ["doc_id", "set_id"], "left_semi").dropDuplicates(["doc_id", "set_id"]))
    # several texts under one doc_id are one node; their sets are tested one by one
    keyed = written(_band_keys(classes))
    total = keyed.count()
    found = None
    for bands in (range(FIRST_BANDS), range(FIRST_BANDS, BANDS)):
        with scope() as keep:
            rows = written(_buckets(keyed, found, bands))
            fresh = _verified(_stars(rows, total * len(bands)), classes, docs)
            found = components(fresh if found is None else fresh.unionByName(found.toDF("a", "b")))
            keep(found)

    with scope() as keep:
        more = _in_blocks(_open(written(_buckets(keyed, found, range(BANDS))), total * BANDS), classes, docs)
        keep(more)

    # several sets under one doc_id tie their classes together
    again = sketch.where("n > 0").groupBy("doc_id").agg(F.count_distinct("set_id").alias("_k")).where("_k > 1").select("doc_id")
    same = sketch.join(again, "doc_id", "left_semi").join(firsts, "set_id").where("doc_id <> rep")
    tied = written(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    final = components(found.toDF("a", "b").unionByName(more).unionByName(tied))
    return sketch, firsts, final


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.seen) AS component_id, r.node = min(r.seen) AS kept
FROM r LEFT JOIN n ON r.node = n.doc_id GROUP BY r.node
"""
