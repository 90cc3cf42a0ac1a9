"""Each corpus operator on small tables: nulls, empty and repeated rows, extra columns, and a brute-force or round-trip check."""

from __future__ import annotations

import glob
import hashlib
import os
import random

import numpy as np
import pytest

from pointlake.llm import chat, decontaminate, digest, langid, licenses, linededup, neardup, pieces, pii, quality

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "x" * 3000, "▁ x▁y\t", "</s>[INST]", "token: \x1a1 \x1a", "中文 é́ 😀", "Line one is here and it is long enough to count.\n" * 3]


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts)], DOCS)


def test_queries_match_sql(spark):
    import duckdb

    from pointlake.llm.queries import QUERIES, SQL

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in SQL.items():
        got, want = QUERIES[name](spark, DATA), c.sql(sql)
        order = sorted(got.columns)
        assert order == sorted(want.columns), name
        assert sorted(str([r[k] for k in order]) for r in got.collect()) == sorted(str([r[want.columns.index(k)] for k in order]) for r in want.fetchall()), name


def test_line_dedup_brute_force(spark):
    rng = random.Random(1)
    pool = [f"This is the shared line number {i} and it is long." for i in range(4)] + ["short", "É is kept apart from é in this long long line here"]
    texts = ["\n".join(rng.choice(pool + [f"own line {i} " * 5]) + rng.choice(["", "  ", "\t"]) for _ in range(4)) for i in range(40)] + ODD
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    docs_of: dict[str, set] = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            docs_of.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in docs_of.items() if len(k) >= 40 and len(v) >= 5}
    out = {r["doc_id"]: r for r in linededup.drop_repeated_lines(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        kept = [x for x in own if not (key(x) in gone and gone[key(x)] != i)]
        assert (out[i]["text"] or "") == "\n".join(kept) and out[i]["_n_lines"] == len(own) and out[i]["_n_dropped"] == len(own) - len(kept)
    assert gone and linededup.drop_repeated_lines(table(spark, []).where("false")).count() == 0
    assert linededup.drop_repeated_lines(table(spark, ["a", None], [None, None])).count() == 2


def test_near_duplicates_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = list(ODD)
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(4):
            own = list(base)
            for _ in range(rng.choice([0, 1, 3])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r["doc_id"]: r for r in neardup.near_duplicates(table(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert neardup.near_duplicates(table(spark, ["a b", "a b", None], [None, 3, 3])).count() == 3


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    reg = lambda s: neardup.registers(neardup.minima(s, np.array([0, len(s)])))
    assert (np.maximum(reg(a), reg(b)) == reg(np.concatenate([a, b]))).all()
    grid = np.linspace(0, 1, 101)
    best = grid[neardup.likelihoods(reg(a), reg(b), np.array([1000.0]), np.array([1000.0]), grid).argmax()]
    assert best == pytest.approx(800 / 1200, abs=0.12)


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (15, 40, 60, 3)]
    rows = [(i, t) for i, t in enumerate([*items, None, ""])]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    fill = lambda n: " ".join(word() for _ in range(n))
    one_off = items[2].split()
    one_off[0] = "changed"
    texts = [f"{fill(50)} {items[0]} {fill(9)}", f"{fill(5)}\n{items[1].upper()}!!", fill(100), " ".join(one_off), f"x {items[3]} y", None, "", f"{fill(40)} {' '.join(items[1].split()[:15])}"]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(table(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (3, 2), (4, 3)}
    assert got[0, 0]["start_word"] == 50 and got[0, 0]["similarity"] == 1 and 0.75 <= got[3, 2]["similarity"] < 1
    assert decontaminate.leaks(table(spark, texts), bench.where("false")).count() == 0


def test_decontamination_weights(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    item = [word(2) for _ in range(5)] + [word(6) for _ in range(35)]
    texts = []
    for cut in (3, 4, 5):  # light words before the passage, very heavy ones after it
        texts.append(" ".join([word(2) for _ in range(30)] + item[cut:] + [word(40) for _ in range(30)]))
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(table(spark, texts), bench).collect()}

    def weights(ws):
        return {tuple(ws[i : i + 5]): sum(map(len, ws[i : i + 5])) for i in range(len(ws) - 4)}

    own, want = weights(item), {}
    for d, t in enumerate(texts):
        ws = t.split()
        for p in range(len(ws) - 29):
            win = weights(ws[p : p + 40])
            both = sum(v for k, v in win.items() if k in own)
            want[d] = max(want.get(d, 0), both / (sum(win.values()) + sum(own.values()) - both))
    want = {d: s for d, s in want.items() if s >= 0.75}
    assert want and set(got) == set(want)
    assert all(abs(got[d]["similarity"] - s) < 1e-12 for d, s in want.items())


def test_chat_round_trip(spark):
    own = chat.tokens(chat.RANKS)
    for t in ODD:
        t = t or ""
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
        for role in ("user", "assistant", "system", "", "tool [TEXT]"):
            ids, at, n = own.segment(role, t)
            assert own.parse(ids) == (role, t) and chat.unescape(own.text(ids[at : at + n])) == t
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "</s>a"), (1, 1, "assistant", "</s>a"), (2, None, None, None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.assemble(chat.segments(turns))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 10 and got[1]["loss_sha256"] == hashlib.sha256(b"</s>a</s>a").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[None]["n_turns"] == 1


def test_pii(spark):
    texts = ["Mail a.b1@mail3.example.com or A.B1@MAIL3.EXAMPLE.COM now", "card 4111111111111111, other 4111111111111112", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "call +1 (017) 555-7713.", "from 83.229.25.121.", "Mrs Anna Berg met Mr. Berg", *ODD]
    out = {r["doc_id"]: r for r in pii.replace_pii(table(spark, texts), b"test").collect()}
    assert "mail3" not in out[0]["text"] and "MAIL3" not in out[0]["text"] and out[0]["text"].split()[1].upper() == out[0]["text"].split()[3]
    new = out[1]["text"].split()[1].rstrip(",")
    assert new != "4111111111111111" and pii.luhn(new) and new[0] == "4" and "4111111111111112" in out[1]["text"]
    assert "04dbebab" not in out[2]["text"] and "555-7713" not in out[3]["text"] and "83.229.25.121" not in out[4]["text"]
    words = out[5]["text"].split()
    assert words[1] in pii.GIVEN["f"] and words[2] == words[5] != "Berg"
    for i, t in enumerate(texts[6:], 6):
        assert out[i]["text"] == t and out[i]["_n_replaced"] == 0
    many = spark.range(3000).selectExpr("'ssn' AS kind", "lpad(id, 9, '0') AS canon", "'' AS gender", "1L AS n")
    got = pii.assign(many, b"test").toPandas()
    assert got["stand_in"].nunique() == 3000 and not set(got["stand_in"]) & set(got["canon"])


def test_pii_secrets_without_digits(spark):
    texts = ["password = correct-horse-battery", "the token: abcdefghijklmnop of 3 others", "use sk-abcdefghijklmnopqrstuvwx here", "a password is short"]
    out = {r["doc_id"]: r for r in pii.replace_pii(table(spark, texts), b"test").collect()}
    for i, secret in enumerate(["correct-horse-battery", "abcdefghijklmnop", "sk-abcdefghijklmnopqrstuvwx"]):
        assert secret not in out[i]["text"] and out[i]["_n_replaced"] == 1
    assert out[3]["text"] == texts[3]


def test_licenses_scan(spark):
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.\nmit\nlicense", "prose\n" + licenses.TEMPLATES[2][1].replace(" and ", "\n"), "GNU General Public License, Apache License and MIT-License", *ODD]
    got = [r for r in licenses.scan_licenses(table(spark, texts)).orderBy("doc_id").collect()]
    assert got[0]["labels"] == "mit" and got[0]["base_labels"] == "mit" and got[0]["first_word"] == 3
    assert got[1]["labels"] == "cc-by,cc-by-nc,mit" and got[1]["base_labels"] == "mit"
    assert "mit" in got[2]["labels"] and got[3]["base_labels"] == "apache,gpl,mit" and got[3]["n_base"] == 3
    assert all(r["n_base"] == 0 and r["score"] == 0 for r in got[4:])
    index = licenses.Index({})
    for _, t in licenses.TEMPLATES:  # against counting without filters
        block = set(licenses.words(t)) | {"the", "of"}
        want = [k for k, (_, u) in enumerate(licenses.TEMPLATES) if len(block & set(licenses.words(u))) >= (1 if len(set(licenses.words(u))) < licenses.SHORT else licenses.SHARE) * len(set(licenses.words(u))) - 1e-9]
        assert sorted(index.met(block)) == want


def test_quality_and_language(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(40))
    texts = [good() if i % 3 else good() + " awful awful" if i % 2 else "%% ## " * 30 for i in range(120)] + ODD
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 and i % 2 == 0 else 1, 1 if i % 3 == 0 and i % 2 else 0) for i in range(0, 90)], "doc_id long, quality int, toxic int")
    docs = table(spark, texts)
    out = {r["doc_id"]: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    kept = [out[i]["_p_ge_2"] >= 0.5 for i in range(90, 120)]
    assert kept == [i % 3 != 0 for i in range(90, 120)] and len(out) == len(texts)
    assert quality.train(docs, labels.where("false")) is None and quality.score(docs, None).where("_p_ge_2 = 1").count() == len(texts)
    lang = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the house and the dog", "en"), ("der hund und das haus", "de")] * 20 + [(None, "en"), ("12 34", "de")])], "doc_id long, text string, lang string")
    model = langid.train(lang)
    got = [r["lang_pred"] for r in langid.predict(lang, *model).orderBy("doc_id").collect()]
    assert got[:4] == ["en", "de", "en", "de"] and got[-2:] == ["und", "und"]
    assert [r["lang_pred"] for r in langid.predict(lang.limit(2), *langid.train(lang.where("false"))).collect()] == ["und", "und"]


def split_ids(codec, raw):
    """Ids of each repetition, split where the text read back so far ends with a whole word."""
    part, text = [], b""
    for i in np.frombuffer(raw, "<i4").tolist():
        part.append(i)
        text += codec.bytes_of[i]
        if text.strip() == b"segmentation":
            yield part
            part, text = [], b""


def test_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    plain, dropped = pieces.Codec(drop=0.0), pieces.Codec(drop=0.3)
    texts = [*ODD, "Hello  world, this is text.", " lead and trail  "]
    for t in texts:
        a, b = plain.encode([t])[0], dropped.encode([t])[0]
        if t is not None and "▁" not in t:
            assert np.frombuffer(a, "<i4").tolist() == sp.encode(t)
        assert plain.decode(a) == dropped.decode(b) == (t or "")
    chunks = [" segmentation", "wordsofsomelength", " é中x", "pad" * 9]
    for v in range(20):
        seeds = np.arange(4, dtype=np.uint64) * np.uint64(977) + np.uint64(v)
        assert dropped._many(chunks, seeds) == [dropped._one(c, int(x)) for c, x in zip(chunks, seeds)]
    own = dropped.encode([" segmentation" * 400])[0]
    assert dropped.decode(own) == " segmentation" * 400 and len({tuple(x) for x in split_ids(dropped, own)}) > 10  # cut anew at each place
    assert dropped.encode(["same text"] * 2)[0] == dropped.encode(["other", "same text"])[1]
    back = pieces.decode(pieces.encode(table(spark, texts)))
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())


def test_fingerprints(spark):
    raw = np.frombuffer(random.Random(5).randbytes(300) + b"a" * 200, np.uint8)
    want = []
    for i in range(len(raw) - digest.WINDOW + 1):
        n = np.unique(raw[i : i + digest.WINDOW], return_counts=True)[1]
        want.append(int((digest._FULL - digest._g[n].sum()) * digest.LEVELS // digest._FULL))
    assert digest.levels(raw).tolist() == want
    texts = [*ODD, "some longer text that is repeated " * 9, "some longer text that is repeated " * 9, "quite another thing, " * 20]
    out = {r["doc_id"]: r for r in digest.fingerprints(table(spark, texts)).collect()}
    n = len(texts)
    assert len(out) == n
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % n] or ""
        k = len(t) // 2
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert 0 <= out[i]["near_next"] <= 1 and 0 <= out[i]["near_edited"] <= 1
    assert out[n - 3]["fingerprint"] == out[n - 2]["fingerprint"] and out[n - 3]["near_next"] == 1 and out[n - 2]["near_next"] < 0.5
    assert digest.fingerprints(table(spark, ["x"]).where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "sentencepiece":
            assert out.columns == docs.columns
            docs = out.cache()
    assert 0 < out.count() <= 200 and "tokens" in out.columns


def test_pipeline_decontaminates_rows_without_id(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"word{i}" for i in range(20))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, [passage, passage, "clean text", None, "other"], [1, None, None, None, 2])
    out = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(str(r["text"]) for r in out.collect()) == ["None", "clean text", "other"]
