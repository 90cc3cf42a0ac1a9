"""Filter interaction audit against plain Python and against its SQL."""

from __future__ import annotations

import random
import re
from itertools import permutations

from pointlake.llm import audit

DOCS = "doc_id long, text string, source string, part string, a int, digest string"
LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """The audit of (doc_id, text, source) rows by applying every order to every document."""
    first, good, toxic = {}, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        bad["E"] = i is not None and t in first and first[t] < i
        fails.append((s or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        mine, shap = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                shap[x] += len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), sum(x in f[1] for f in mine) - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone), x]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shap[v[6]] if isinstance(v[6], str) else v[6]
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "clash", 1, "clash") for i, t, s in rows], DOCS)
    out = audit.audit(audit.flagged(docs, spark.createDataFrame(labels, LABELS))).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in out}
    assert len(found) == len(out)
    return found


def test_matches_plain_python(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "The", "THE", "of", "x" * 9, "é", "a|b", "#1", f"w{rng.randrange(400)}", f"v{rng.randrange(400)}"])
    texts = [" ".join(word() for _ in range(rng.choice([3, 49, 50, 51, 120]))) for _ in range(60)] + ["plain " + " ".join(f"w{i}" for i in range(n)) for n in (48, 49, 60)] * 2
    texts += [None, "", "", " \n\t", "A", "word " * 40_000, " ".join("ab" for _ in range(70)), "A" * 5 + "b" * 95, "A" * 6 + "b" * 94]
    rows = [(i, t, rng.choice(["s1", "s1", "s2", None, ""])) for i, t in enumerate(texts)]
    rows += [(None, texts[0], "s1"), (None, None, "s3"), (3, texts[3], "s2"), (3, texts[5], "s1"), (-1, texts[7], None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70, 2)] + [(2, 1, 1), (None, 1, 1)]
    got, want = run(spark, rows, labels), plain(rows, labels)
    assert {k: (v, want.get(k)) for k, v in got.items() if v != want.get(k)} == {}
    assert {k[0] for k in got} == {"", "s1", "s2", "s3"} and len(got) == 4 * 600
    assert max(v[1] for v in got.values()) > 5 and max(v[4] for v in got.values()) > 0


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert len(run(spark, [(1, "a", "s")], [])) == 600
