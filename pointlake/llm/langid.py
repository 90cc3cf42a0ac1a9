"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every character that is no letter becomes a space, runs of spaces become one, and n-grams of
1 to 3 characters are hashed to BUCKETS buckets. Training counts n-grams per language in every partition and
adds them up; the log-probability matrix (BUCKETS x languages, Laplace smoothed) has a size that does not depend on
the corpus and is broadcast. The class prior is a language's share of the training rows' count (all of them,
not of the sample). Scoring is one gather and one segmented sum per piece of a batch and language; a text of any length
is taken PIECE n-gram places at a time, so memory beside the text itself is bounded.

Training rows have a doc_id, a non-null language and text; without any, all predictions are `und`. Of each language
about PER_LANG rows are taken (a documented bound): those whose 64-bit hash of doc_id lies below a share of the whole
range, fitted to the language's own count, so a rare language keeps all its rows and no share rounds to none. Rows
repeated under one doc_id are taken or left together. Every row is scored.

Null or letterless text is `und` with score 0. Of equally probable languages the first in order of name is predicted.
Empty tables give empty tables; only doc_id, text and lang are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import arrow, sliced, table

BUCKETS, GRAMS, PER_LANG, SMOOTH, PIECE = 1 << 16, (1, 2, 3), 5_000, 0.5, 1 << 18
_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
_P = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, the text of each, letters of each text)."""
    low = [(t or "").lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[cp]
    owner = np.repeat(np.arange(len(low), dtype=np.int32), size)
    letters = np.bincount(owner, letter, len(low)).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    return np.where(letter, cp, np.uint32(32))[keep], owner[keep], letters


def grams(cp: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every n-gram, those of PIECE starts at a time."""
    most = max(GRAMS)
    for at in range(0, len(cp), PIECE):
        part, own = cp[at : at + PIECE + most - 1], owner[at : at + PIECE + most - 1]
        h = np.zeros(len(part), np.uint32)
        for n in GRAMS:
            m = len(part) - n + 1
            if m <= 0:
                break
            h = h[:m] * _P[0] + part[n - 1 :] * _P[1] + np.uint32(n)
            g = h ^ (h >> np.uint32(15))
            g = g * _P[2]
            g ^= g >> np.uint32(13)
            whole = own[:m] == own[n - 1 :]
            whole[PIECE:] = False  # starts of the next piece
            yield own[:m][whole], (g & np.uint32(BUCKETS - 1))[whole].astype(np.int64)


def train(rows: DataFrame, prior: dict[str, int] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """rows (text, lang) -> (languages in order, log-probabilities BUCKETS x languages, log-priors from prior's counts)."""

    def count(batches):
        for batch in batches:
            for part in sliced(batch) if batch.num_rows else []:
                langs = part.column(1).dictionary_encode()
                code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for own, bucket in grams(*normalised(part.column(0).to_pylist())[:2]):
                    key, n = np.unique(code[own] * BUCKETS + bucket, return_counts=True)
                    key, at = np.unique(np.append(total[0], key), return_inverse=True)
                    total = key, np.bincount(at, np.append(total[1], n)).astype(np.int64)
                key, n = total
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // BUCKETS)).cast(pa.string()), pa.array(key % BUCKETS), pa.array(n)], names=["lang", "bucket", "n"])

    found = (
        rows.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.full((BUCKETS, len(langs)), SMOOTH)
    place = {x: i for i, x in enumerate(langs)}
    names = found["lang"].combine_chunks().dictionary_encode()
    at = np.array([place[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy(zero_copy_only=False)] if len(found) else np.zeros(0, np.int64)
    counts[found["bucket"].to_numpy(), at] += found["n"].to_numpy()
    of = np.array([(prior or {}).get(x, 1) for x in langs], float)
    return langs, np.log(counts / counts.sum(0)).astype(np.float32) if langs else counts.astype(np.float32), np.log(of / of.sum()) if langs else of


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, prior: np.ndarray) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang_pred, score); score is the posterior of the language predicted."""
    held = docs.sparkSession.sparkContext.broadcast((logp.T.copy(), prior))

    def run(batch: pa.RecordBatch):
        cp, owner, letters = normalised(batch.column(1).to_pylist())
        n, k = batch.num_rows, len(langs)
        matrix, first = held.value
        level = np.tile(first, (n, 1)) if k else np.zeros((n, 1))
        for own, bucket in grams(cp, owner):
            if k and len(own):
                low, high = own[0], own[-1] + 1
                for j in range(k):
                    level[low:high, j] += np.bincount(own - low, matrix[j][bucket], high - low)
        best = level.argmax(1)
        post = 1 / np.exp(np.minimum(level - level.max(1, keepdims=True), 0)).sum(1)
        known = (letters > 0) & (k > 0)
        return {"doc_id": batch.column(0), "lang_pred": [langs[b] if ok else "und" for b, ok in zip(best, known)], "score": np.where(known, post, 0.0)}

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train_sample(docs: DataFrame, limit: int = PER_LANG) -> tuple[DataFrame, dict[str, int]]:
    """(rows to learn from, rows that each language has): about `limit` rows of each language by a hash of doc_id."""
    rows = docs.select("doc_id", "text", "lang").where(~held_out()).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    taken = F.lit(False)
    for lang, n in sorted(counts.items()):
        below = -(2**63) + min(2**64 * limit // n, 2**64 - 1)
        taken = taken | ((F.col("lang") == lang) & (F.xxhash64("doc_id") <= F.lit(below)))
    return rows.where(taken), counts


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample, counts = train_sample(docs)
    found = predict(docs, *train(sample, counts))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
