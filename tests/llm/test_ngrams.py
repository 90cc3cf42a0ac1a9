"""Trigram scoring against a plain dictionary model, and monotone sequences against sorted arrays."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm import ngrams
from pointlake.llm.eliasfano import Levels

DOCS = "doc_id long, text string, n_tokens int, score string, shard int"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0d]+", low), 0]


def plain(train, texts, d=ngrams.DISCOUNT):
    """(n_tokens, n_known, base, score) of each text by dictionaries of counts."""
    one, two, three = Counter(), defaultdict(Counter), defaultdict(Counter)
    for t in train:
        a = b = 1
        for w in tokens(t):
            one[w] += 1
            two[b][w] += 1
            three[a, b][w] += 1
            a, b = b, w
    n, v = sum(one.values()), len(one)

    def step(of, w, lower):
        c = sum(of.values())
        return lower if not c else max(of[w] - d, 0) / c + d * len(of) / c * lower

    out = []
    for t in texts:
        a = b = 1
        base = full = 0.0
        for w in tokens(t):
            p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            full += math.log10(step(three.get((a, b), {}) and three[a, b], w, step(two.get(b, {}) and two[b], w, p)) if n else 1.0)
            a, b = b, w
        out.append((len(tokens(t)), sum(one[w] > 0 for w in tokens(t)), base, full))
    return out, n


def same(spark, rows, shard_bytes, parts=4):
    docs = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], DOCS).repartition(parts, F.xxhash64("text", "doc_id"))
    got = ngrams.score(docs, ~ngrams.held_out(), shard_bytes=shard_bytes).collect()
    learn = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    want, n = plain([t for (_, t), x in zip(rows, learn) if x], [t for _, t in rows])
    left = defaultdict(list)
    for (i, _), w in zip(rows, want):
        left[i].append(w)
    assert len(got) == len(rows)
    for r in sorted(got, key=lambda r: r["score"]):
        hit = [w for w in left[r["doc_id"]] if w[:2] == (r["n_tokens"], r["n_known"]) and abs(w[2] - r["base_score"]) < 1e-6 and abs(w[3] - r["score"]) < 0.0005 * w[0]]
        assert hit and r["train_tokens"] == n, (r, left[r["doc_id"]])
        left[r["doc_id"]].remove(hit[0])


@pytest.mark.parametrize("shard_bytes", [400, 3000, 1 << 20])
def test_matches_plain_model(spark, shard_bytes):
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(60)] + ["The", "the", "É", "é", "of"] * 8
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(120)]
    texts += ["the same passage in a third of all rows of the table"] * 60 + [None, "", " \n\t", "x" * 5000, "the of " * 2000, "the the the the", "\x85 \xa0 中文"]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, None), (4, "again the fourth"), (4, texts[4]), (-3, "the of")]
    same(spark, rows, shard_bytes)


def test_hot_keys_are_spread(spark):
    texts = ["the same passage in a third of all rows"] * 50 + [f"the same a{i} of b{i} the c{i}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    layout = ngrams._layout(docs.select(F.col("doc_id").alias("key"), "text", F.lit(True).alias("learn")), 400)
    assert layout.shards > 8 and len(layout.words) and len(layout.pairs) and all(len(s) > 1 for s in layout.pair_shards)
    assert len(layout.words) + len(layout.pairs) < 8 * layout.shards
    same(spark, list(enumerate(texts)), 400)


def test_learned_rows_only(spark):
    texts, asked = ["a b c", "a b d", "b c a b", ""], [*(f"a b {w}" for w in "abcd"), "a b zz", "a b"]
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(asked, 100)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ngrams.score(docs, F.col("doc_id") < 4).collect()}
    want, _ = plain(texts, asked)
    for i, w in enumerate(want, 100):
        assert abs(got[i] - w[3]) < 0.0005 * w[0]
    assert got[102] > got[100] > got[104]  # seen after a b, seen elsewhere, unknown


def test_no_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in ngrams.score(docs, F.lit(False)).orderBy("doc_id").collect()] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert ngrams.score(docs.where("doc_id > 5"), F.lit(True)).collect() == []


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (7, 8), (1000, 1001), (1000, 2**64 - 1), (50_000, 10**6), (50_000, 2**40)])
def test_monotone_sequences(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    seq = Levels({"x": v, "y": np.sort(rng.integers(0, 9, n)).astype(np.uint64)}, {"z": v}).sequence("x")
    assert (seq.get(np.arange(len(v))) == v).all()
    q = np.sort(np.concatenate([v, rng.integers(0, top, 200, dtype=np.uint64), np.array([0, top], np.uint64)]))
    at = np.searchsorted(v, q)
    want = [i if i < len(v) and v[i] == x else -1 for i, x in zip(at, q)]
    assert seq.find(q).tolist() == want
