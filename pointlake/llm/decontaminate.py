r"""Benchmark decontamination with DataFrame operations only.

Words are what stands between runs of [\x00-\x2F\x3A-\x60\x7B-\x7F] in the lower-cased text; shingles have five words
(an item with fewer words is one shingle).

1. Windows. For an item of n words a document's windows are n words long (less only at the text's end). A window that
   shares no shingle with any item of that size has similarity 0; every other window is made: those that begin with a
   shingle of such an item, and those that begin before the first one they hold. The latter reach back from places whose
   shingle is one and whose preceding shingle is none. (Moving a window right to its first shared shingle keeps the count
   of shared shingles but not their share of the characters: what comes in may be heavier than what goes out.)
   Texts are cut into chunks of CHUNK starts, with as many words around them as the longest item has, so that no row
   carries a long text and the work on a text is linear in its length.
2. SimHash. A window's fingerprint has 60 bits: bit j is set if it is set in the hashes of more than half of the words.
   Counts of three bits share a long, so a window takes 20 sums and not 60.
3. Multi-index blocks. The fingerprint is cut into four blocks of 15 bits. Within Hamming distance RADIUS = 15 some block
   differs in at most three bits; items are listed under every value within three bits of each block, windows look up
   their four blocks as they are. This equi-join returns every item within the radius; the exact distance follows.
   A passage at similarity 0.75 differs in about one word of 35 from its item, in expectation 5 bits, at most 7.5 for the
   shortest items, so the radius leaves three standard deviations and more. The tests measure this recall.
4. Verify. Similarity is the weighted Jaccard of the distinct shingles, a shingle weighing its number of characters
   (at most 255). Rows of at least SIMILARITY are leaks; for each (document, item) the best window, then the
   first, is returned. Hashes are 64-bit, with 56 bits kept beside the weight.

Only tables derived from the benchmark are broadcast, and only where their rows and arrays take at most BROADCAST_BYTES,
counted first; beyond that the same joins shuffle ids of chunks, and the words are joined to what is left.
Nothing pairs documents with each other.

Null and empty texts and items have no words and match nothing; empty tables give no rows. Repeated documents of one
doc_id are one document, rows without a doc_id together are one (null) document; the same holds for items and item_id.
Only doc_id, item_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import table

SHINGLE, SIMILARITY, RADIUS = 5, 0.75, 15
LANE, LANES, BLOCKS, BLOCK_BITS, NEAR = 20, 3, 4, 15, 3
CHUNK = 256
BROADCAST_BYTES, ROW_BYTES = 256 << 20, 128
_CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(F.lower(text), _CUT, -1), ""), F.array().cast("array<string>"))


def hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def gram(hs: str, at: Column, k: int) -> Column:
    """Hash of the k-word shingle at a place of an array of word hashes; null where the words do not suffice."""
    return F.when((at >= 0) & (at + k <= F.size(hs)), F.xxhash64(*[F.get(hs, at + j) for j in range(k)]))


def weighted(ws: Column, size: Column) -> Column:
    """Distinct shingles as longs: 56 bits of hash and 8 of weight. Up to five words make one shingle."""
    k = F.least(F.lit(SHINGLE), size)

    def one(i: Column) -> Column:
        part = F.slice(ws, i + 1, k)
        weight = F.least(F.aggregate(part, F.lit(0), lambda s, w: s + F.length(w)), F.lit(255)).cast("bigint")
        return F.xxhash64(part).bitwiseAND(F.lit(~255)).bitwiseOR(weight)

    return F.when(F.size(ws) >= k, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(ws) - k), one))).otherwise(F.array().cast("array<bigint>"))


def weight_of(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("bigint"), lambda s, e: s + e.bitwiseAND(F.lit(255)))


def with_fingerprint(df: DataFrame, ws: str) -> DataFrame:
    """df with `fp`, the SimHash of the words in column ws. (As SQL text: building so many columns one by one takes seconds.)"""
    mask, low = sum(1 << (LANE * i) for i in range(LANES)), (1 << LANE) - 1
    own = [f"`{c}`" for c in df.columns]
    sums = [f"aggregate(_h, 0L, (s, h) -> s + (shiftrightunsigned(h, {k}) & {mask}L)) AS _s{k}" for k in range(LANE)]
    bits = [f"IF((shiftright(_s{k}, {LANE * i}) & {low}L) * 2 > size(`{ws}`), {1 << (LANE * i + k)}L, 0L)" for k in range(LANE) for i in range(LANES)]
    return df.withColumn("_h", hashes(F.col(ws))).selectExpr(*own, *sums).selectExpr(*own, " | ".join(bits) + " AS fp")


def _block(fp: Column, b: int) -> Column:
    return F.shiftright(fp, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _masks() -> list[int]:
    return [sum(1 << i for i in c) for n in range(NEAR + 1) for c in combinations(range(BLOCK_BITS), n)]


def _chunks(docs: DataFrame, longest: int) -> DataFrame:
    """(r1, r2, doc_id, at, lo, ws): words lo.. of a text, those from `longest` before place `at` on; at is every CHUNK-th
    place (every longest-th for longer items). r1 and r2 are 128 bits of hash of the row."""
    step = max(CHUNK, longest)
    base = docs.select(F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("r2"), "doc_id", words(F.col("text")).alias("_w"))

    def cut(at: Column) -> Column:
        lo = F.greatest(at - longest, F.lit(0))
        return F.struct(at.alias("at"), lo.alias("lo"), F.slice("_w", lo + 1, at - lo + step + longest).alias("ws"))

    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(step)), cut)
    # outer: a plain explode makes Spark compute the words twice, for a filter on their number
    return base.select("r1", "r2", "doc_id", F.explode_outer(cuts).alias("c")).select("r1", "r2", "doc_id", "c.*")


_CHUNK_KEY = ["r1", "r2", "at"]


def _windows(chunks: DataFrame, items: DataFrame, k: int, step: int) -> DataFrame:
    """(doc_id, r1, r2, at, pos, size, win): the windows that hold a k-word shingle of an item; pos counts from the text's start."""
    own = items.where(F.col("size") >= k) if k == SHINGLE else items.where(F.col("size") == k)
    starts = own.select("size", hashes(F.col("item_words")).alias("_h")).select("size", "_h", F.posexplode("_h").alias("_q", "_"))
    starts = starts.select(gram("_h", F.col("_q"), k).alias("sh"), "size").where("sh IS NOT NULL").distinct()
    small = starts.count() * ROW_BYTES <= BROADCAST_BYTES
    rows = chunks.withColumn("_h", hashes(F.col("ws"))).select("*", F.posexplode_outer("_h").alias("_q", "_"))
    rows = rows.where((F.col("_q") >= F.col("at") - F.col("lo")) & (F.col("_q") < F.col("at") - F.col("lo") + step))
    rows = rows.withColumns({"sh": gram("_h", F.col("_q"), k), "before": gram("_h", F.col("_q") - 1, k)}).drop("_h", "_")
    found = rows.join(F.broadcast(starts), "sh") if small else rows.drop("ws").join(starts, "sh")
    if k == SHINGLE:
        inner = starts.select(F.col("sh").alias("before"), "size", F.lit(True).alias("inner"))
        back = F.sequence(F.greatest(F.lit(0), F.col("_q") - F.col("size") + k), F.col("_q"))
        found = found.join(F.broadcast(inner) if small else inner, ["before", "size"], "left")
        found = found.withColumn("_q", F.explode(F.when(F.col("inner"), F.array("_q")).otherwise(back)))
    if not small:
        found = found.select("doc_id", *_CHUNK_KEY, "lo", "_q", "size").distinct().join(chunks.select(*_CHUNK_KEY, "ws"), _CHUNK_KEY)
    return found.select("doc_id", *_CHUNK_KEY, (F.col("_q") + F.col("lo")).alias("pos"), "size", F.slice("ws", F.col("_q") + 1, F.col("size")).alias("win"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the benchmark items that each document holds."""
    items = benchmark.select("item_id", words(F.col("text")).alias("item_words")).withColumn("size", F.size("item_words")).where("size > 0")
    items = with_fingerprint(items, "item_words").withColumn("item_sh", weighted(F.col("item_words"), F.col("size")))
    items = items.select(F.xxhash64("item_id", "item_words").alias("_i"), "item_id", "size", F.col("fp").alias("item_fp"), "item_sh", "item_words")
    facts = items.agg(F.count("*").alias("n"), F.max("size").alias("longest"), F.sum(F.size("item_sh") * 8 + ROW_BYTES).alias("bytes"), F.collect_set(F.when(F.col("size") < SHINGLE, F.col("size"))).alias("short")).first()
    longest, step = facts["longest"] or 1, max(CHUNK, facts["longest"] or 1)

    chunks = _chunks(docs, longest)
    windows = _windows(chunks, items, SHINGLE, step)
    for k in sorted(facts["short"]):
        windows = windows.unionByName(_windows(chunks, items, k, step))
    windows = with_fingerprint(windows.where(F.size("win") >= F.col("size") * similarity), "win")

    entry = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("item_fp"), b).alias("value")) for b in range(BLOCKS)])
    listed = items.select("_i", "size", F.explode(entry).alias("e")).select("_i", "size", "e.block", "e.value")
    near = listed.select("_i", "size", "block", "value", F.expr(f"explode(array({', '.join(f'{m}L' for m in _masks())}))").alias("m"))
    near = near.select("size", "block", F.col("value").bitwiseXOR(F.col("m")).alias("value"), "_i")
    small = (facts["n"] or 0) * BLOCKS * len(_masks()) * ROW_BYTES + (facts["bytes"] or 0) <= BROADCAST_BYTES
    held = F.broadcast if small else (lambda df: df)
    probe = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)])
    probes = (windows if small else windows.drop("win")).withColumn("e", F.explode(probe)).select("*", "e.block", "e.value").drop("e")
    pairs = probes.join(held(near), ["size", "block", "value"]).join(held(items.select("_i", "item_id", "item_fp", "item_sh")), "_i")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(F.bit_count(_block(apart, b)) <= NEAR, F.lit(b)) for b in range(BLOCKS)])
    pairs = pairs.withColumn("hamming", F.bit_count(apart).cast("int")).where((F.col("hamming") <= RADIUS) & (F.col("block") == first))
    if not small:
        pairs = pairs.join(chunks.select(*_CHUNK_KEY, "lo", "ws"), _CHUNK_KEY).withColumn("win", F.slice("ws", F.col("pos") - F.col("lo") + 1, F.col("size"))).drop("ws", "lo")

    both = pairs.withColumn("win_sh", weighted(F.col("win"), F.col("size")))
    both = both.withColumn("_both", weight_of(F.array_intersect("win_sh", "item_sh")))
    both = both.withColumn("_all", weight_of(F.col("win_sh")) + weight_of(F.col("item_sh")) - F.col("_both"))
    sure = both.where((F.col("_all") > 0) & (F.col("_both") >= F.col("_all") * F.lit(similarity)))
    best = sure.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("_both") / F.col("_all")).alias("similarity"), (-F.col("pos")).alias("back"), F.size("win").alias("n"), (-F.col("hamming")).alias("h"))).alias("b")
    )
    return best.select(
        "doc_id", "item_id", (-F.col("b.back")).cast("bigint").alias("start_word"), F.col("b.n").cast("bigint").alias("n_words"),
        (-F.col("b.h")).alias("hamming"), F.col("b.similarity").alias("similarity"),
    )


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Hamming distance stays out: SQL has no such hash."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")


#: Similarity of every window of every item's size, without fingerprints; windows that share no shingle with the item have 0.
OP1_SQL = r"""
WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
i AS (SELECT row_number() OVER () AS iid, item_id, ws, len(ws) AS size, least(5, len(ws)) AS k FROM iw WHERE len(ws) > 0),
ish AS (SELECT DISTINCT iid, item_id, size, k, array_to_string(ws[p:p + k - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, size - k + 2)) AS p FROM i)),
d AS (SELECT row_number() OVER () AS did, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
ds AS (SELECT did, k, p AS q, array_to_string(ws[p:p + k - 1], ' ') AS sh FROM (SELECT did, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
hit AS (SELECT did, iid, size, q, ds.k FROM ds JOIN ish ON ds.sh = ish.sh AND ds.k = ish.k),
w AS (SELECT DISTINCT did, iid, size, k, p FROM (SELECT did, iid, size, k, unnest(range(greatest(1, q - size + k), q + 1)) AS p FROM hit)),
wd AS (SELECT did, size, k, p, ws[p:p + size - 1] AS win FROM (SELECT DISTINCT did, size, k, p FROM w) JOIN d USING (did) WHERE len(ws[p:p + size - 1]) >= 0.75 * size),
wsh AS (SELECT DISTINCT did, size, p, array_to_string(win[r:r + k - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, len(win) - k + 2)) AS r FROM wd)),
wt AS (SELECT did, size, p, sum(least(length(replace(sh, ' ', '')), 255)) AS t FROM wsh GROUP BY ALL),
it AS (SELECT iid, any_value(item_id) AS item_id, sum(least(length(replace(sh, ' ', '')), 255)) AS t FROM ish GROUP BY iid),
c AS (SELECT did, p, size, iid, sum(least(length(replace(sh, ' ', '')), 255)) AS b FROM wsh JOIN ish USING (sh, size) GROUP BY ALL),
f AS (SELECT d.doc_id, it.item_id, p - 1 AS start_word, len(win) AS n_words, c.b / (wt.t + it.t - c.b) AS similarity
  FROM c JOIN wd USING (did, size, p) JOIN wt USING (did, size, p) JOIN it USING (iid) JOIN d USING (did) WHERE c.b >= 0.75 * (wt.t + it.t - c.b))
SELECT doc_id, item_id, start_word::BIGINT AS start_word, n_words::BIGINT AS n_words, similarity::DOUBLE AS similarity FROM f
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word, n_words DESC) = 1
"""
