"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

Grades: 0 toxic, 1 low quality, 2 good (of several labels of one document the lowest). One score s = w . x, shared
by all grades, and ordered thresholds: P(grade <= k) = sigmoid(t_k - s) with t_0 < t_1. It gives the expected grade and
the tail probabilities P(grade >= k) for selection. Features x: the document's distinct words hashed to WIDTH
buckets, and WIDTH buckets more for coarse shape figures (share of symbols, of repeated words, of bars).

Training uses at most MAX_TRAIN labelled documents (documented bound, chosen by a hash of doc_id) and of each at most
MAX_FEATURES features, those that come first in a fixed pseudo-random order of all features (a documented bound too, for
training alone: 12,000 documents then take 200 MB at most). It is fitted on the driver by full-batch Adam with
L2; words that fewer than MIN_DOCS of them hold are left out. Every document is scored, in whole and with all features.

Of several labels of a doc_id the lowest grade counts; of several texts of one the one with the smallest features is
learned from, and all are scored. Labels with a null doc_id, or neither toxic nor with a quality, are left out. Without
labels of at least two grades nothing can be told apart: every document gets the top grade. Null and empty texts have
no words and are scored by shape alone. A text of any length is one row. Empty tables give empty tables. Columns named
_expected_grade, _p_ge_1 or _p_ge_2 are replaced; other extra columns stay and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm import wordhash
from pointlake.llm.common import added, arrow, table

WIDTH, SHAPES, GRADES = 1 << 18, 64, 3
MAX_TRAIN, MAX_FEATURES, MIN_DOCS, STEPS, L2 = 12_000, 4_096, 4, 160, 0.25
KEEP_TAIL = 0.5
_CLASS = np.zeros(256, np.int64)  # 0 letter or digit, 1 space, 2 plain punctuation, 3 other symbol
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 2
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 3


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature of every entry, each text's first entry and the end); the features of a text are distinct."""
    hashes, at = wordhash.words(texts)
    raw, off = wordhash.buffers(texts)
    bucket = (hashes >> np.uint64(40)).astype(np.int64) & (WIDTH - 1)
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    kind = np.bincount(owner * 4 + _CLASS[raw], minlength=4 * n).reshape(n, 4)
    rows, to = [], [0]
    for i in range(n):
        own = np.unique(bucket[at[i] : at[i + 1]])
        total, words = max(off[i + 1] - off[i], 1), at[i + 1] - at[i]
        symbols = min(int(8 * np.log2(1 + 64 * kind[i, 3] / total) / 6), 7)
        repeats = min(int(8 * (1 - len(own) / max(words, 1))), 7)
        length = min(int(np.log2(words + 1)), 15)
        rows += [own, np.array([WIDTH + symbols, WIDTH + 8 + repeats, WIDTH + 16 + length, WIDTH + 32 + min(int(8 * kind[i, 2] / max(words, 1)), 7)])]
        to.append(to[-1] + len(own) + 4)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.array(to)


def bounded(own: np.ndarray) -> np.ndarray:
    """At most MAX_FEATURES of a text's features, the same ones of any two texts that share them."""
    if len(own) <= MAX_FEATURES:
        return own
    return np.sort(own[np.argsort(wordhash.mix(own.astype(np.uint64) + np.uint64(1)), kind="stable")[:MAX_FEATURES]])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(feature: np.ndarray, row: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the penalised likelihood, by Adam on all rows at once."""
    size = WIDTH + SHAPES
    common = np.bincount(feature, minlength=size) >= MIN_DOCS
    use = common[feature]
    names, f = np.unique(feature[use], return_inverse=True)
    row, n = row[use], len(grade)
    w, t = np.zeros(len(names)), np.array([-2.0, 1.0])  # t[1] is the gap to the second threshold, as a log
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros(2), np.zeros(2)]
    share = np.bincount(grade, minlength=GRADES) / n
    weight = np.where(share > 0, 1 / np.maximum(share, 1e-9), 0) ** 0.5
    weight = (weight / (weight * share).sum())[grade]
    for step in range(1, STEPS + 1):
        s = np.bincount(row, w[f], n)
        cut = np.array([-np.inf, t[0], t[0] + np.exp(t[1]), np.inf])
        high, low = sigmoid(cut[grade + 1] - s), sigmoid(cut[grade] - s)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high), low * (1 - low)
        ds = weight * (d_high - d_low) / p / n  # of the negative log-likelihood
        gw = np.bincount(f, ds[row], len(w)) + L2 / n * w * 10
        g0 = -(weight * (d_high * (grade < 2) - d_low * (grade > 0)) / p).sum() / n
        g1 = -(weight * (d_high * (grade == 1) - d_low * (grade == 2)) / p).sum() / n * np.exp(t[1])
        for k, (x, g) in enumerate(((w, gw), (t, np.array([g0, g1])))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(size, np.float32)
    weights[names] = w
    return weights, np.array([t[0], t[0] + np.exp(t[1])])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, grade) of at most `limit` labelled documents; the label side of the join is bounded by that limit."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("_grade")).where("_grade IS NOT NULL")
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("_grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN):
    """Fitted (weights, thresholds), or None where there is nothing to tell apart."""

    def run(batch: pa.RecordBatch):
        entry, to = features(batch.column(1))
        own = [entry[to[i] : to[i + 1]] for i in range(batch.num_rows)]
        return {"doc_id": batch.column(0), "f": [bounded(x).astype("<i4").tobytes() for x in own], "grade": batch.column(2)}

    made = arrow(labelled_sample(docs, labels, limit), run, "doc_id long, f binary, grade int")
    rows = made.groupBy("doc_id").agg(F.min("f").alias("f"), F.min("grade").alias("grade")).toArrow().to_pydict()
    order = sorted(range(len(rows["grade"])), key=lambda i: (rows["f"][i], rows["grade"][i]))
    grade = np.array([rows["grade"][i] for i in order], np.int64)
    if len(set(grade.tolist())) < 2:
        return None
    entries = [np.frombuffer(rows["f"][i], "<i4") for i in order]
    return fit(np.concatenate(entries).astype(np.int64), np.repeat(np.arange(len(order)), [len(x) for x in entries]), grade)


def score(docs: DataFrame, model) -> DataFrame:
    """docs with _expected_grade, _p_ge_1, _p_ge_2; all columns of docs stay."""
    docs, schema = added(docs, "_expected_grade double, _p_ge_1 double, _p_ge_2 double")
    names, at = docs.columns, docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        n = batch.num_rows
        if held.value is None:
            one = np.ones(n)
            return dict(zip(names, batch.columns)) | {"_expected_grade": 2 * one, "_p_ge_1": one, "_p_ge_2": one}
        weights, cuts = held.value
        entry, to = features(batch.column(at))
        s = np.add.reduceat(weights[entry].astype(float), to[:-1])
        tail1, tail2 = sigmoid(s - cuts[0]), sigmoid(s - cuts[1])
        return dict(zip(names, batch.columns)) | {"_expected_grade": tail1 + tail2, "_p_ge_1": tail1, "_p_ge_2": tail2}

    return arrow(docs, run, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", F.col("_expected_grade").alias("expected_grade"), F.col("_p_ge_1").alias("p_not_toxic"),
        F.col("_p_ge_2").alias("p_good"), (F.col("_p_ge_2") >= KEEP_TAIL).alias("kept"),
    )
