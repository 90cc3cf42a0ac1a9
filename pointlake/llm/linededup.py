"""Line dedup: lines that many documents share go, except in the document with the largest id that has them.

A text is split at \\n (null or empty: one empty line). A line's key is the line without ASCII white space at both
ends, A-Z lower-cased; a key is known by a 128-bit hash. A key of at least `min_chars` code points found in at
least `min_docs` distinct doc_ids loses its lines everywhere but in the largest of them. Rows of one doc_id count
as one document. A row whose doc_id is null isn't counted and keeps all its lines. All other columns stay.

Only (hash, doc_id) pairs are shuffled to count: first made distinct, dealt by all three, then counted in every task
before the hashes are dealt out, so a line that a third of all documents hold loads no task. Very common lines are
broadcast to hand decisions back (at most HOT_KEYS of them, by counting), the others are joined by a shuffle.

Columns named _n_lines or _n_dropped are replaced; other extra columns may have any name. A text of any
length is one row; its lines are handled one by one. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import added, arrow, free, hot_join, table, written

MIN_CHARS, MIN_DOCS = 40, 5
_STRIP = b" \t\n\x0b\x0c\r"


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16-byte hash of a line's key; None for a key that is too short to count."""
    key = line.strip(_STRIP).lower()
    return hashlib.blake2b(key, digest_size=16).digest() if _long_enough(key, min_chars) else None


def _occurrences(min_chars: int):
    def run(batch: pa.RecordBatch):
        ids, keys = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if doc is not None and text:
                own = {k for line in text.split(b"\n") if len(line) >= min_chars and (k := key_of(line, min_chars))}
                keys += own
                ids += [doc] * len(own)
        pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        return {"h1": pa.array(pairs[:, 0]), "h2": pa.array(pairs[:, 1]), "doc_id": ids} if ids else None

    return run


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id, text, ...) with text rewritten, plus _n_lines and _n_dropped."""
    docs, schema = added(docs, "_n_lines long, _n_dropped long")
    occ = written(arrow(docs.select("doc_id", "text"), _occurrences(min_chars), "h1 long, h2 long, doc_id long").distinct())
    shared = written(occ.groupBy("h1", "h2").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_last")).where(F.col("_n") >= min_docs))
    gone = (
        hot_join(occ, shared, ["h1", "h2"], "_n", occ.count())
        .where(F.col("doc_id") != F.col("_last"))
        .groupBy(F.col("doc_id").alias("_of"), F.lit(0).alias("_part"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("_gone"))
    )
    # rows without a doc_id match nothing: a second key spreads them over the tasks
    part = F.when(F.col("d.doc_id").isNull(), F.pmod(F.xxhash64("d.text"), F.lit(10_000))).otherwise(0)
    joined = docs.alias("d").join(gone.alias("g"), (F.col("d.doc_id") == F.col("g._of")) & (part == F.col("g._part")), "left").select("d.*", F.col("g._gone").alias(free(docs, "_gone")))
    names, text_at = docs.columns, docs.columns.index("text")

    def rewrite(batch: pa.RecordBatch):
        drops = batch.column(batch.num_columns - 1)
        texts, lines, dropped = [], [], []
        for text, drop in zip(batch.column(text_at).to_pylist(), drops.to_pylist()):
            if not drop:
                texts.append(text)
                lines.append(1 if not text else text.count("\n") + 1)
                dropped.append(0)
                continue
            bad = {int(d["h1"]).to_bytes(8, "little", signed=True) + int(d["h2"]).to_bytes(8, "little", signed=True) for d in drop}
            own = text.encode().split(b"\n") if text else [b""]
            kept = [x for x in own if key_of(x, min_chars) not in bad]
            texts.append(b"\n".join(kept).decode())
            lines.append(len(own))
            dropped.append(len(own) - len(kept))
        return {c: batch.column(i) for i, c in enumerate(names)} | {"text": texts, "_n_lines": lines, "_n_dropped": dropped}

    return arrow(joined, rewrite, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, s.last IS NOT NULL AND k.doc_id <> s.last AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
