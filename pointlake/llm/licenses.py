r"""License scans: an exact set-similarity join of text blocks with license templates.

Words are runs matching [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased; null counts as empty. For a template of
n words a block is a run of at most SPAN * n words in a row, wherever lines end, so wrapped notices are found and the words
of a long text do not add up to one. A block meets a template where it holds at least SHARE of the template's distinct
words (containment).

Template words are ordered by how often they stand in all documents, rarest first (ties by word). With o
words needed, a match must share one of the first |T| - o + 1 words of T (prefix filter), have at least o
words known to any template (length filter), and from its first shared word on have enough words left on both sides
(positional filter). A text's whole set of words contains those of each of its blocks, so the filters and an exact count
on it leave few templates; for these a window slides over the places of the template's words. Every qualifying block is
found; the score is the best containment. The work is linear in a text's length for each template left. The template index
is a constant of this module, bounded by it; documents are never joined with each other.

Besides, base phrases are found wherever their words stand one after another.

Every row of docs gives a row, repeated ones too and those without a doc_id; empty tables give empty tables. Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import arrow, ascii_lower, table

SHARE, SHORT, SPAN = 0.85, 12, 2
#: Phrases and labels of the base scan.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices and opening passages of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_BASE = [(re.compile(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(p.split()) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"), label) for p, label in PHRASES.items()]


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_UPPER)) if text else []


VOCABULARY = frozenset(w for _, t in TEMPLATES for w in words(t))


class Index:
    """Templates as sorted token ids, and their prefixes as an inverted index."""

    def __init__(self, counts: dict[str, int], share: float = SHARE):
        order = sorted(VOCABULARY, key=lambda w: (counts.get(w, 0), w))
        self.place = {w: i for i, w in enumerate(order)}
        self.templates = [(label, sorted({self.place[w] for w in words(t)})) for label, t in TEMPLATES]
        self.names = [frozenset(words(t)) for _, t in TEMPLATES]
        self.span = [SPAN * len(words(t)) for _, t in TEMPLATES]
        self.need = [len(t) if len(t) < SHORT else math.ceil(share * len(t) - 1e-9) for _, t in self.templates]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.templates):
            for i, w in enumerate(t[: len(t) - self.need[k] + 1]):
                self.index.setdefault(w, []).append((k, i))
        self.rare = frozenset(w for w in VOCABULARY if self.place[w] in self.index)

    def met(self, block: set[str]) -> list[int]:
        """The templates that a set of distinct words meets."""
        own = sorted(self.place[w] for w in block & VOCABULARY)
        seen, found = set(), []
        for j, w in enumerate(own):
            for k, i in self.index.get(w, ()):
                t = self.templates[k][1]
                if k in seen:
                    continue
                seen.add(k)  # the first shared word decides: none before it is shared
                if len(own) >= self.need[k] and 1 + min(len(t) - i - 1, len(own) - j - 1) >= self.need[k]:
                    if len(set(own).intersection(t)) >= self.need[k]:
                        found.append(k)
        return found

    def best(self, k: int, own: list[str]) -> int:
        """Most distinct words of template k in one block of a text."""
        names, span, held, at, most = self.names[k], self.span[k], Counter(), 0, 0
        places = [i for i, w in enumerate(own) if w in names]
        for i in places:
            held[own[i]] += 1
            while places[at] <= i - span:
                gone = own[places[at]]
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                at += 1
            most = max(most, len(held))
        return most


def scan(text: str | None, index: Index) -> tuple[int, int, int | None, int | None, set[str], set[str], float]:
    """(words, base places, first, last, base labels, labels, score) of one text."""
    low = (text or "").translate(_UPPER)
    own = _WORD.findall(low)
    starts, base = [], set()
    if "license" in low:
        hits = sorted((m.start(), label) for pattern, label in _BASE for m in pattern.finditer(low))
        count = done = 0
        for at, label in hits:
            count += len(_WORD.findall(low, done, at))
            done = at
            starts.append(count)
            base.add(label)
    labels, score = set(base), 1.0 if base else 0.0
    block = VOCABULARY.intersection(own)
    if not index.rare.isdisjoint(block):
        for k in index.met(block):
            most = index.best(k, own)
            if most >= index.need[k]:
                labels.add(index.templates[k][0])
                score = max(score, most / len(index.names[k]))
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), base, labels, score


def frequencies(docs: DataFrame) -> dict[str, int]:
    """How often each template word stands in all documents: at most |VOCABULARY| rows come back."""
    parts = F.split(ascii_lower(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    rows = docs.select(F.explode_outer(parts).alias("word")).where(F.col("word").isin(sorted(VOCABULARY))).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def scan_licenses(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """docs (doc_id, text) -> a row for each document with its places, labels and score."""
    index = Index(frequencies(docs), share)

    def run(batch: pa.RecordBatch):
        rows = [scan(text, index) for text in batch.column(1).to_pylist()]
        names = ("n_words", "n_base", "first_word", "last_word")
        out = {n: [r[i] for r in rows] for i, n in enumerate(names)}
        joined = {n: [",".join(sorted(r[i])) for r in rows] for i, n in ((4, "base_labels"), (5, "labels"))}
        return {"doc_id": batch.column(0)} | out | joined | {"score": [float(r[6]) for r in rows]}

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    temp = ", ".join(f"({k}, '{label}', {SPAN * len(words(t))}, {w!r})" for k, (label, t) in enumerate(TEMPLATES) for w in sorted(set(words(t))))
    phrases = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, i - 1 AS st FROM p WHERE " + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(p.split())) for p, label in PHRASES.items())
    return rf"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
d AS (SELECT doc_id, low, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE list_contains(ws, 'license')),
b AS ({phrases}),
base AS (SELECT doc_id, count(*) AS n, min(st) AS lo, max(st) AS hi FROM b GROUP BY doc_id),
t(k, label, span, w) AS (VALUES {temp}), tn AS (SELECT k, label, count(*) AS n FROM t GROUP BY k, label),
o AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
tw AS (SELECT doc_id, k, span, w, i FROM o JOIN t USING (w)),
m AS (SELECT x.doc_id, x.k, x.i, count(DISTINCT y.w) AS c FROM tw x JOIN tw y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i >= x.i AND y.i < x.i + x.span
  SEMI JOIN (SELECT doc_id, k FROM tw JOIN tn USING (k) GROUP BY ALL HAVING count(DISTINCT w) >= if(any_value(n) < {SHORT}, any_value(n), ceil({SHARE} * any_value(n) - 1e-9))) z ON x.doc_id = z.doc_id AND x.k = z.k GROUP BY ALL),
f AS (SELECT doc_id, label, max(c) / n AS share FROM m JOIN tn USING (k) GROUP BY doc_id, k, label, n HAVING max(c) >= if(n < {SHORT}, n, ceil({SHARE} * n - 1e-9))),
l AS (SELECT doc_id, label FROM f UNION SELECT doc_id, label FROM b),
s AS (SELECT doc_id, max(share) AS share FROM (SELECT doc_id, share FROM f UNION ALL SELECT doc_id, 1.0 FROM b) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM b WHERE b.doc_id = d.doc_id), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM l WHERE l.doc_id = d.doc_id), '') AS labels,
  coalesce(s.share, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP4_SQL = _sql()
