"""Each pipeline stage, on what its predecessor kept, against plain Python over all rows; the classifier's fit and held-out figures."""

from __future__ import annotations

import math
import re
import shutil

import numpy as np
import pyarrow as pa

from pointlake.llm import pieces, quality, wordhash

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def ascii_low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def plain_features(text):
    """The distinct features of a text, a word at a time."""
    low = [w for w in SPACE.split(text or "") if w]
    own = {int(wordhash.words(pa.array([w]))[0][0] >> np.uint64(40)) & (quality.WIDTH - 1) for w in low}
    raw = (text or "").encode()
    symbols = sum(b in b"#$%&*+/<=>@[\\]^_`{|}~" for b in raw) / max(len(raw), 1)
    marks = sum(b in b".,;:!?'\"-()" for b in raw) / max(len(low), 1)
    shape = [min(int(8 * math.log2(1 + 64 * symbols) / 6), 7), 8 + min(int(8 * (1 - len(own) / max(len(low), 1))), 7), 16 + min(int(math.log2(len(low) + 1)), 15), 32 + min(int(8 * marks), 7)]
    return own | {quality.WIDTH + s for s in shape}


def plain_lines(rows):
    key = lambda x: ascii_low(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows.items():
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    return {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t in rows.items()}


def plain_groups(rows):
    sets = {}
    for i, t in rows.items():
        w = [x for x in SPACE.split(ascii_low(t or "")) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in rows:
        for j in rows:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in rows}


def plain_leaks(rows, items):
    """Ids of documents with an item-sized window whose weighted shingles are similar to the item's, over every window."""
    split = lambda t: [w for w in WORD.split((t or "").lower()) if w]
    weight = lambda s: sum(min(sum(map(len, g)), 255) for g in s)
    bench = [w for w in map(split, items) if w]
    out = set()
    for i, t in rows.items():
        w = split(t)
        for item in bench:
            n, k = len(item), min(5, len(item))
            want = {tuple(item[j : j + k]) for j in range(n - k + 1)}
            grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            if want.isdisjoint(grams):
                continue  # every window has similarity 0
            for s in range(len(grams)):
                have = set(grams[s : s + n - k + 1])
                if weight(have & want) >= 0.75 * weight(have | want) - 1e-9:
                    out.add(i)
                    break
    return out


def test_every_stage_brute_force(spark, tmp_path):
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()]
    good = [r["text"] for r in docs.where("length(text) BETWEEN 400 AND 3000 AND lang = 'en'").orderBy("doc_id").limit(60).collect()]
    line = "This line stands in many documents and it is long enough to go."
    planted = [f"{g}\n{line}" for g in good[:8]] + [g + " and so on" for g in good[8:16]] + [f"{g}\n{x}\n{h}" for g, x, h in zip(good[16:24], items, good[24:32])]
    rows = [(10_000 + i, t, "en", "planted", len(t)) for i, t in enumerate(planted)] + [(10_900, "", "en", "s", 0), (10_901, None, None, None, None)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    docs, sf_dir = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    stages, at, counts = dict(corpus_pipeline.STAGES), docs, []

    def step(name):
        out = stages[name](spark, at, sf_dir)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        path = str(tmp_path / f"after_{name}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        counts.append(out.count())
        return texts(at), texts(out), out

    before, after, kept = step("quality_classifier")
    weights, cuts = quality.train(at, spark.read.parquet(f"{DATA}/labels.parquet"))
    tail = {i: 1 / (1 + math.exp(cuts[1] - sum(float(weights[f]) for f in plain_features(t)))) for i, t in before.items()}
    assert all(abs(p - quality.KEEP_TAIL) > 1e-9 for p in tail.values())
    assert after == {i: t for i, t in before.items() if tail[i] > quality.KEEP_TAIL} and 0 < len(after) < len(before)
    at = kept

    before, after, kept = step("line_dedup")
    want = plain_lines(before)
    assert {i: t or "" for i, t in after.items()} == want and any((before[i] or "") != want[i] for i in want)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.where("text IS NOT NULL").collect() if (before[r["doc_id"]] or "") != r["text"])
    at = kept

    before, after, kept = step("near_dedup")
    group = plain_groups(before)
    assert after == {i: t for i, t in before.items() if group[i] == i} and len(after) < len(before)
    at = kept

    before, after, kept = step("decontamination")
    gone = plain_leaks(before, items)
    assert after == {i: t for i, t in before.items() if i not in gone} and gone
    at = kept

    before, after, out = step("sentencepiece")
    assert after == before and {r["doc_id"]: r["decoded"] for r in pieces.decode(out).collect()} == {i: t or "" for i, t in before.items()}
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.select("doc_id", "text", "tokens").collect())) == sorted(map(str, out.select("doc_id", "text", "tokens").collect()))


def test_fit_by_loops():
    """The fit against a row-at-a-time version of the same steps."""
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    grade = np.array([0 if 1 in x else 2 if 3 in x else 1 for x in own])
    weights, cuts = quality.fit(np.concatenate(own), np.repeat(np.arange(60), [len(x) for x in own]), grade)
    n, sig = 60, lambda x: 1 / (1 + math.exp(-max(min(x, 40), -40)))
    share = [float((grade == g).mean()) for g in range(3)]
    raw = [share[g] ** -0.5 if share[g] else 0 for g in range(3)]
    unit = sum(r * s for r, s in zip(raw, share))
    names = [f for f in range(12) if sum(f in x for x in own) >= quality.MIN_DOCS]
    value = {f: 0.0 for f in names} | {"t0": -2.0, "t1": 1.0}
    m, v = dict.fromkeys(value, 0.0), dict.fromkeys(value, 0.0)
    for step in range(1, quality.STEPS + 1):
        grad = {f: quality.L2 / n * value[f] * 10 for f in names} | {"t0": 0.0, "t1": 0.0}
        t0, gap = value["t0"], math.exp(value["t1"])
        for x, g in zip(own, grade):
            s = sum(value[f] for f in x if f in value)
            high, low = (1.0 if g == 2 else sig((t0, t0 + gap)[g] - s)), (0.0 if g == 0 else sig((t0, t0 + gap)[g - 1] - s))
            w, p = raw[g] / unit, max(high - low, 1e-12)
            dh, dl = high * (1 - high), low * (1 - low)
            for f in x:
                if f in value:
                    grad[f] += w * (dh - dl) / p / n
            grad["t0"] -= w * (dh * (g < 2) - dl * (g > 0)) / p / n
            grad["t1"] -= w * (dh * (g == 1) - dl * (g == 2)) / p / n * gap
        for k in value:
            m[k] += 0.1 * (grad[k] - m[k])
            v[k] += 0.01 * (grad[k] ** 2 - v[k])
            value[k] -= 0.05 * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    assert np.allclose(weights[names], [value[f] for f in names], atol=1e-4) and np.allclose(cuts, [value["t0"], value["t0"] + math.exp(value["t1"])], atol=1e-4)


def test_held_out_labels(spark):
    """Trained on the labels of four fifths of the ids and judged on the other fifth, with the shipped settings."""
    from pyspark.sql import functions as F

    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.train(docs, labels.where(~held))
    judged = quality.score(docs.where(held), model).join(labels, "doc_id")
    good = judged.where("quality = 1 AND toxic = 0").agg(F.avg((F.col("_p_ge_2") >= quality.KEEP_TAIL).cast("double"))).first()[0]
    bad = judged.where("quality = 0 OR toxic = 1").agg(F.avg((F.col("_p_ge_2") >= quality.KEEP_TAIL).cast("double"))).first()[0]
    assert good > 0.9 and bad < 0.5
