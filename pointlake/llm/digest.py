"""Document fingerprints from improbable features.

1. Every window of WINDOW bytes of a text's UTF-8 has an entropy level (0..LEVELS, Shannon entropy of its byte
   values, exact sliding sums). Over all windows of all documents the levels are counted; a window's rank is its
   level's place from rarest to commonest, so the ranks have fixed size whatever the corpus. Levels below WEAK are
   never chosen while others exist.
2. Among each run of BLOCK neighbouring windows the lowest rank (leftmost of equals) gets a point; windows with at
   least POINTS points are features. If none has, the lowest-ranked window is; a text shorter than a window is its
   own feature.
3. Distinct features go into a chain of Bloom filters of BITS bits, five bits each, PER_FILTER features to a filter.
4. Likeness: for each filter of the shorter chain the best overlap with a filter of the other, less the overlap
   expected by chance, as a share of the fuller filter's bits; averaged with the filters' bit counts as weights. Two empty
   fingerprints are alike (1), an empty and another one are not (0).

A fingerprint is text: the number of features, a colon, and the filters in base64. Equal texts give equal
fingerprints under the same ranks. Ranks follow from all texts of a run; to compare fingerprints of several runs, keep
rarity() of one and hand it to the others.

Null counts as empty. Documents are ordered by doc_id, rows of one doc_id by text (null first); rows without a doc_id come
before all others, ordered by a hash of their text, so that very many of them are spread too. Every row gives a row.
A single document's next one is itself. Empty tables give empty tables. Only doc_id and text are read, so other columns
may have any name. A text of any length is handled alone, in memory of about 100 times its bytes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pointlake.llm.common import record, sliced, table

WINDOW, BLOCK, POINTS, LEVELS, WEAK = 64, 64, 16, 1000, 100
BITS, PER_FILTER, PROBES, SLICE = 2048, 160, 5, 384 << 10
_g = np.array([0] + [round(c * np.log2(c) * 1024) for c in range(1, WINDOW + 1)], np.int64)
_GAIN = (_g[1:] - _g[:-1]).astype(np.int64)
_FULL = int(np.log2(WINDOW)) * WINDOW * 1024


def levels(raw: np.ndarray) -> np.ndarray:
    """Entropy level of the window that begins at each byte (len(raw) - WINDOW + 1 of them)."""
    n = len(raw)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (raw[d:] == raw[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    total = np.cumsum(_GAIN[before])
    gone = np.cumsum(_GAIN[after])
    held = total[WINDOW - 1 :].copy()
    held[1:] -= gone[: n - WINDOW]
    return ((_FULL - held) * LEVELS // _FULL).astype(np.int64)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    return np.frombuffer(b"".join(texts), np.uint8), off


def _inside(off: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the first n - width + 1 places begin a stretch of `width` bytes within one text."""
    ok = np.ones(n - width + 1, bool)
    for end in off[1:-1]:
        ok[max(0, end - width + 1) : end] = False
    return ok


def histogram(texts: list[bytes]) -> np.ndarray:
    raw, off = _joined(texts)
    if len(raw) < WINDOW:
        return np.zeros(LEVELS + 1, np.int64)
    return np.bincount(levels(raw)[_inside(off, len(raw), WINDOW)], minlength=LEVELS + 1)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Level -> rank: rare levels first, weak ones last."""
    level = np.arange(LEVELS + 1)
    order = np.lexsort((level, counts, level < WEAK))
    out = np.empty(LEVELS + 1, np.int64)
    out[order] = level
    return out


def _hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of bytes (a multiple of 8)."""
    from pointlake.llm.wordhash import mix

    words = np.ascontiguousarray(rows).view("<u8")
    h = np.full(len(rows), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = mix(h ^ words[:, k])
    return h


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The distinct feature hashes of each text in order of place."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    for i, t in enumerate(texts):
        if 0 < len(t) < WINDOW:
            out[i] = _hash(np.frombuffer(hashlib.blake2b(t).digest(), np.uint8)[None, :])
    long = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
    if not long:
        return out
    raw, off = _joined([texts[i] for i in long])
    n = len(raw) - WINDOW + 1
    key = (ranks[levels(raw)] << 32) | np.arange(n)
    key[~_inside(off, len(raw), WINDOW)] = np.iinfo(np.int64).max
    least, width = key, 1
    while width < BLOCK:
        least = np.minimum(least[: len(least) - width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    if len(least):
        whole = _inside(off, len(raw), WINDOW + BLOCK - 1)
        points = np.bincount(least[: len(whole)][whole] & 0xFFFFFFFF, minlength=n)
        chosen = np.flatnonzero(points >= POINTS)
    else:
        chosen = np.zeros(0, np.int64)
    at = np.searchsorted(chosen, off)
    rows = [chosen[at[j] : at[j + 1]] for j in range(len(long))]
    for j, own in enumerate(rows):
        if not len(own):
            rows[j] = np.array([key[off[j] : off[j + 1] - WINDOW + 1].min() & 0xFFFFFFFF])
    places = np.concatenate(rows)
    hashes = np.concatenate([_hash(raw[p[:, None] + np.arange(WINDOW)]) for p in np.array_split(places, len(places) // 8192 + 1)])
    to = np.append(0, np.cumsum([len(r) for r in rows]))
    for j, i in enumerate(long):
        own = hashes[to[j] : to[j + 1]]
        out[i] = own[np.sort(np.unique(own, return_index=True)[1])]
    return out


def filters(own: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters (filters x BITS / 8 bytes)."""
    chain = np.zeros((-(-len(own) // PER_FILTER), BITS), bool)
    line = np.arange(len(own)) // PER_FILTER
    for k in range(PROBES):
        chain[line, ((own >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(chain, axis=1)


def text_of(n: int, chain: np.ndarray) -> str:
    return f"{n}:{base64.b64encode(chain.tobytes()).decode()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    a, b = a.view("<u8"), b.view("<u8")
    n_b, total, weight = np.bitwise_count(b).sum(1).astype(float), 0.0, 0.0
    for row in a:
        n_a = float(np.bitwise_count(row).sum())
        both = np.bitwise_count(row[None, :] & b).sum(1).astype(float)
        chance, most = n_a * n_b / BITS, np.maximum(n_a, n_b)
        share = np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), both == most)
        total, weight = total + n_a * float(np.clip(share, 0, 1).max()), weight + n_a
    return total / weight


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks from the entropy levels of all windows of all documents."""

    def count(batches):
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for part in sliced(batch, SLICE):
                total += histogram([(t or b"") for t in part.column(0).cast(pa.binary()).to_pylist()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["level", "n"])

    found = docs.select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS + 1, np.int64)
    for row in found:
        counts[row["level"]] = row["n"]
    return ranks_of(counts)


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches, ranks: np.ndarray, schema: pa.Schema):
    """Rows (bucket, tail, doc_id, text) in order -> a result row for each that is no tail, from it and the next row."""
    held = None  # (bucket, tail, doc_id, text, fingerprint) that waits for its next row
    for batch in batches:
        for part in sliced(batch, SLICE) if batch.num_rows else []:
            cols = [part.column(i).to_pylist() for i in range(4)]
            rows = list(zip(*cols))
            texts = [r[3] or "" for r in rows]
            edits, pairs = [], []
            before = held
            for r, text in zip(rows, texts):
                if before is not None and not before[1] and before[0] == r[0]:
                    k = len(before[3]) // 2
                    edits.append(before[3][: len(before[3]) - k] + text[:k])
                    pairs.append((before, r))
                before = (r[0], r[1], r[2], text)
            raw = [t.encode() for t in texts]
            raw_edits = [t.encode() for t in edits]
            found = features(raw + raw_edits, ranks)
            chains = [filters(x) for x in found]
            out = {name: [] for name in schema.names}
            e = 0
            for i, r in enumerate(rows):
                if held is not None and not held[1] and held[0] == r[0]:
                    edit, chain, n = raw_edits[e], chains[len(raw) + e], len(found[len(raw) + e])
                    out["doc_id"].append(held[2])
                    out["n_chars"].append(len(held[3]))
                    out["edited_sha256"].append(hashlib.sha256(edit).hexdigest())
                    out["fingerprint"].append(text_of(held[4], held[5]))
                    out["edited_fingerprint"].append(text_of(n, chain))
                    out["near_edited"].append(likeness(held[5], chain))
                    out["near_next"].append(likeness(held[5], chains[i]))
                    e += 1
                held = (r[0], r[1], r[2], texts[i], len(found[i]), chains[i])
            if out["doc_id"]:
                yield record(out, schema)


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """docs (doc_id, text) -> fingerprints of each text and its edited text, with their likeness and the next text's.

    Buckets of consecutive documents are partitions; each also gets the first document of the next bucket (the last bucket
    that of the first) as a tail row. One shuffle of the texts; only bucket bounds and the buckets' first rows' keys, one
    for each bucket, come to the driver.
    """
    from pyspark.ml.feature import Bucketizer

    spark, schema = docs.sparkSession, to_arrow_schema(StructType.fromDDL(_FIELDS))
    ranks = rarity(docs) if ranks is None else ranks
    place = F.coalesce(F.col("doc_id").cast("double"), F.xxhash64(F.coalesce("text", F.lit(""))).cast("double") - F.lit(2e19))
    docs = docs.select(place.alias("_b"), "doc_id", "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    bounds = sorted(set(docs.approxQuantile("_b", [i / n for i in range(1, n)], min(0.2 / n, 0.001)))) if n > 1 else []
    dealt = Bucketizer(splits=[-float("inf"), *(bounds or [0.0]), float("inf")], inputCol="_b", outputCol="_cut")
    placed = dealt.transform(docs).withColumn("_bucket", F.col("_cut").cast("int")).drop("_cut")
    firsts = sorted((r["_bucket"], r["_b"]) for r in placed.groupBy("_bucket").agg(F.min("_b").alias("_b")).collect())
    if not firsts:
        return spark.createDataFrame([], _FIELDS)
    tails = spark.createDataFrame([(firsts[i - 1][0], b) for i, (_, b) in enumerate(firsts)], "_to int, _b double")
    # of the rows at a bucket's first place the first: a minimum, so that no group of rows is copied
    row = F.struct("doc_id", F.col("text").isNotNull().alias("_t"), "text")
    tail_rows = docs.join(F.broadcast(tails), "_b").groupBy("_to", "_b").agg(F.min(row).alias("r")).select(F.col("_to").alias("_bucket"), F.lit(1).alias("_tail"), "_b", "r.doc_id", "r.text")
    rows = placed.select("_bucket", F.lit(0).alias("_tail"), "_b", "doc_id", "text").unionByName(tail_rows)
    ordered = rows.repartitionById(len(bounds or [0]) + 1, F.col("_bucket")).sortWithinPartitions("_bucket", "_tail", "_b", "doc_id", "text")
    return ordered.select("_bucket", "_tail", "doc_id", "text").mapInArrow(lambda batches: _compare(batches, ranks, schema), _FIELDS)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
