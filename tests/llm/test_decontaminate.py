"""Decontamination against every window in Python: edits at both ends, heavy tokens, recall, long texts, both join ways."""

from __future__ import annotations

import random

from pointlake.llm import decontaminate

CUT = __import__("re").compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in CUT.split((text or "").lower()) if w]


def weights(ws, k):
    return {tuple(ws[i : i + k]): min(sum(map(len, ws[i : i + k])), 255) for i in range(len(ws) - k + 1)}


def brute(texts, items):
    """{(doc, item): similarity} of the best window of each document, over all windows."""
    out = {}
    for i, item in enumerate(items):
        iw = words(item)
        n, k = len(iw), min(5, len(iw))
        if not n:
            continue
        own = weights(iw, k)
        for d, text in enumerate(texts):
            ws = words(text)
            for p in range(len(ws)):
                win = weights(ws[p : p + n], k)
                if len(ws[p : p + n]) < 0.75 * n or not (own.keys() & win.keys()):
                    continue
                both = sum(v for s, v in win.items() if s in own)
                sim = both / (sum(win.values()) + sum(own.values()) - both)
                if sim >= 0.75:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def tables(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_long_token_after_a_changed_first_word(spark):
    rng = random.Random(1)
    word = lambda n=5: "".join(rng.choice("abcdefgh") for _ in range(n))
    item = [word() for _ in range(15)]
    text = " ".join([word() for _ in range(20)] + ["changed"] + item[1:] + [word(64)] + [word() for _ in range(20)])
    want = brute([text], [" ".join(item)])
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(*tables(spark, [text], [" ".join(item)])).collect()}
    assert want and set(got) == set(want) and abs(got[0, 0] - want[0, 0]) < 1e-12


def edited(rng, word, item):
    """An item with words changed, added or gone, more often at its ends."""
    own = list(item)
    for _ in range(rng.choice([0, 1, 1, 2])):
        at = rng.choice([0, len(own) - 1, rng.randrange(len(own))])
        own[at : at + 1] = rng.choice([[], [word()], [own[at], word()], [word(rng.choice([2, 60]))]])
    return own


def test_recall_over_random_edits(spark):
    rng = random.Random(2)
    word = lambda n=0: "".join(rng.choice("abcdefghij") for _ in range(n or rng.randrange(2, 9)))
    items = [" ".join(word() for _ in range(n)) for n in (3, 14, 15, 15, 20, 27, 33, 40, 48, 59)]
    texts = [" ".join([word() for _ in range(rng.randrange(40))] + edited(rng, word, items[d % 10].split()) + [word() for _ in range(rng.randrange(40))]) for d in range(160)]
    want = brute(texts, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(*tables(spark, texts, items)).collect()}
    assert len(want) > 80 and set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-12 or got[k] < want[k] for k in got)
    assert len(got) >= 0.98 * len(want)  # of the Hamming radius


def test_shuffled_joins_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [" ".join(word() for _ in range(n)) for n in (4, 16, 30)]
    texts = [" ".join([word()] * rng.randrange(300) + items[d % 3].split()[d % 2 :] + [word() for _ in range(20)]) for d in range(12)] + [None, ""]
    key = lambda rows: sorted(tuple(r) for r in rows)
    small = key(decontaminate.leaks(*tables(spark, texts, items)).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert {r[:2] for r in small} == set(brute(texts, items)) and key(decontaminate.leaks(*tables(spark, texts, items)).collect()) == small


def test_odd_rows(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, "x"), (1, passage, "x"), (None, "a " + passage, "x"), (None, None, None), (2, "", None), (3, "... !", None)], "doc_id long, text string, pos string")
    bench = spark.createDataFrame([(0, passage, "y"), (0, passage, "y"), (None, passage + " more", "y"), (5, None, None), (6, "", None)], "item_id long, text string, fp string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["hamming"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 0): (0, 0), (None, 0): (1, 0), (1, None): got[1, None], (None, None): got[None, None]}
    assert decontaminate.leaks(docs.where("false"), bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0


def test_long_text(spark):
    passage = " ".join(f"word{i}" for i in range(30))
    text = "lorem ipsum dolor " * 150_000 + passage + " sit amet" * 100_000  # 3.6 MB
    got = decontaminate.leaks(*tables(spark, [text, "short"], [passage])).collect()
    assert [(r["doc_id"], r["start_word"], r["similarity"]) for r in got] == [(0, 450_000, 1.0)]
