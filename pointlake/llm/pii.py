r"""PII surrogates: detected entities are replaced by keyed, type-consistent stand-ins.

Found: e-mail addresses, IPv4 addresses, payment cards (13-19 digits that pass the Luhn check), phone numbers
(+country or bracketed area forms), US social security numbers, IBANs (mod-97), secrets (a value assigned to token,
key, secret or password; well-known key prefixes), and names after a title of address.

A person of a text is what a title of address names: the words after it are given name and surname, a single word is the
surname (the given name where the text has it as one). All other capitalised mentions of these words in the text, with
or without a title, are replaced too.

An entity is (kind, canonical form): letter case, spacing and punctuation don't matter, so all mentions in all documents
share one stand-in (coreference). A given name's gender is that of most titled mentions in all documents (f of as many), of none
where no title tells. A stand-in follows from a keyed hash of (kind, canonical form, attempt) and keeps the
kind's form: digits stay digits, letters keep case and script, cards pass Luhn and keep their first digit, IBANs pass
mod-97, addresses stay in their address block, hex stays hex, given names keep their gender.
It is written in the mention's own layout.

Collision checks make stand-ins distinct: a stand-in that is an entity of the corpus itself, or that two entities of a
kind draw, goes to the smallest of them at most and the others draw again, until none is left. A form that is nearly full
(more than GROW draws) gets longer by a digit or letter for each further draw, addresses leave their block, so drawing ends.
The entity table is distributed; it is pre-aggregated, so an entity in a third of all documents is one row. Only the number
of entities that must draw again comes to the driver.

The key is a parameter without a default: keep it secret and the same for runs that must agree. The query reads
spark.pointlake.pii.key and draws a key for the session where that is unset.

Null text stays null; empty texts and texts without entities come back unchanged. Entities are handed back by a hash of the
row (doc_id and text), so rows without a doc_id and repeated rows are like others. Entities have no upper bound of length; the work
on a text is linear in its length. Columns named _n_replaced or _kinds are replaced, other extra columns stay and may have
any name. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import added, arrow, free, hot_join, scope, table, written

GROW = 8
#: Given names by gender (stand-ins).
GIVEN = {
    "f": "Ada Alma Anna Berta Clara Dora Edith Elena Emma Eva Flora Greta Hanna Helena Ida Ines Irma Julia Lena Lina Maria Marta Mia Nora Olga Paula Rosa Sara Tina Vera".split(),
    "m": "Adam Albert Anton Bruno Carl Daniel David Emil Erik Felix Georg Hugo Ivan Jakob Jan Josef Julian Karl Lars Leo Lukas Martin Max Nils Oskar Otto Paul Peter Simon Viktor".split(),
}
#: Titles of address and the gender they give (n: none).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f"}
_CAP = r"[^\W\d_]{2,}"
#: (kind, what every match holds, pattern); None stands for a digit, "" for nothing.
_PATTERNS = [
    ("email", "@", re.compile(r"(?<![\w.%+\-])[\w.%+\-]{1,64}@[\w\-]{1,63}(?:\.[\w\-]{1,63}){1,8}(?<![\-_])")),
    ("secret", "", re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_\-+/]{12,}(?:\.[A-Za-z0-9_\-+/]+)*={0,2})|\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9\-_]{20,}|xox[bap]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]+){1,4})\b")),
    ("iban", None, re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", None, re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)")),
    ("phone", None, re.compile(r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,5}(?:[ .\-]\d{2,5}){1,4}(?![\d\-])|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])")),
    ("ssn", None, re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\d\-])")),
    ("card", None, re.compile(r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\d\-])")),
]
_NAMES = re.compile(rf"\b({'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ \xa0]({_CAP})(?:[ \xa0]({_CAP}))?")
_WORD = re.compile(_CAP)
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def find(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical form, gender that a title tells or "") of the entities of a text, in order, none overlapping."""
    found: list[tuple[int, int, str, str, str]] = []
    if not text:
        return found
    taken = bytearray(len(text))

    def add(start, end, kind, canon, gender=""):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind, canon, gender))

    digits = _DIGIT.search(text) is not None
    for kind, hint, pattern in _PATTERNS:
        if (hint is not None and hint not in text) or (hint is None and not digits):
            continue
        for m in pattern.finditer(text):
            raw = m[0]
            if kind == "secret":
                g = 1 if m[1] else 2
                add(m.start(g), m.end(g), kind, m[g])
            elif kind == "email":
                add(m.start(), m.end(), kind, raw.lower())
            elif kind == "ip":
                add(m.start(), m.end(), kind, ".".join(str(int(x)) for x in raw.split(".")))
            elif kind == "iban":
                canon = raw.replace(" ", "")
                if 15 <= len(canon) <= 34 and iban_rest(canon) == 1:
                    add(m.start(), m.end(), kind, canon)
            else:
                canon = "".join(c for c in raw if c.isdigit())
                if kind != "card" or luhn(canon):
                    add(m.start(), m.end(), kind, canon)
    titled = []
    for m in _NAMES.finditer(text):
        named = [(m.start(g), m.end(g), m[g].lower()) for g in (2, 3) if m[g]]
        if named[-1:] and len(named) == 2 and text[named[1][0]].islower():
            named.pop()
        if not text[named[0][0]].islower():
            titled.append((TITLES[m[1]], named))
    given = {named[0][2] for _, named in titled if len(named) == 2}
    kinds = {}
    for gender, named in titled:
        for k, (s, e, low) in enumerate(named):
            kind = "given" if len(named) == 2 and k == 0 or len(named) == 1 and low in given else "surname"
            add(s, e, kind, low, gender.replace("n", "") if kind == "given" else "")
            kinds.setdefault(low, kind)
    if kinds:
        for m in _WORD.finditer(text):
            low = m[0].lower()
            if low in kinds and not m[0][0].islower():
                add(m.start(), m.end(), kinds[low], low)
    return sorted(found)


class _Stream:
    """A keyed stream of numbers for one (kind, canonical form, attempt)."""

    def __init__(self, kind: str, canon: str, attempt: int, key: bytes):
        self.seed, self.block, self.rest = f"{kind}\0{canon}\0{attempt}".encode(), 0, 0
        self.key = hashlib.sha256(key).digest()

    def below(self, n: int) -> int:
        if self.rest < 1 << 64:
            self.rest = int.from_bytes(hashlib.blake2b(self.seed + self.block.to_bytes(4, "little"), key=self.key).digest(), "little")
            self.block += 1
        self.rest, out = divmod(self.rest, n)
        return out


_VOWEL, _CONSONANT = "aeiou", "bcdfghjklmnprstvz"


def _like(c: str, s: _Stream) -> str:
    """A character of the same class, case and script."""
    if c.isdigit():
        return str(s.below(10))
    if not c.isalpha():
        return c
    if c.isascii():
        low = c.lower()
        new = _VOWEL[s.below(5)] if low in _VOWEL else _CONSONANT[s.below(len(_CONSONANT))]
        return new.upper() if c.isupper() else new
    script = unicodedata.name(c, "?").split()[0]
    if script == "LATIN":
        new = _VOWEL[s.below(5)]
        return new.upper() if c.isupper() else new
    base = ord(c) & ~0x1F  # the same row of 32 letters of its script
    pool = [chr(x) for x in range(base, base + 32) if chr(x).isalpha() and chr(x).isupper() == c.isupper() and unicodedata.name(chr(x), "?").split()[0] == script]
    return pool[s.below(len(pool))]


def _checked(body: str, ok) -> str:
    """body with its last digit set so that ok holds."""
    return next((body[:-1] + d for d in "0123456789" if ok(body[:-1] + d)), body)


def surrogate(kind: str, canon: str, gender: str, attempt: int, key: bytes) -> str:
    """The stand-in's canonical form; from attempt GROW on it gets longer (an address leaves its block)."""
    s = _Stream(kind, canon, attempt, key)
    longer = max(attempt - GROW + 1, 0)
    digits = "".join(str(s.below(10)) for _ in range(longer))
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        head = ["".join(_like(c, s) for c in x) for x in labels[:-2]]
        more = "".join(_like("b", s) for _ in range(longer))
        return "".join(_like(c, s) for c in local) + more + "@" + ".".join([*head, "example", labels[-1]] if len(labels) > 1 else labels)
    if kind == "ip":
        a, b = canon.split(".")[:2]
        fixed = [] if longer else [a] if a in ("10", "127") else [a, b] if (a, b) == ("192", "168") else []
        first = [str(1 + s.below(9) if int(a) < 10 else 10 + s.below(90) if int(a) < 100 else 100 + s.below(124))] if not fixed else []
        return ".".join([*fixed, *first, *(str(s.below(256)) for _ in range(4 - len(fixed) - len(first)))])
    if kind == "card":
        return _checked(canon[0] + "".join(str(s.below(10)) for _ in canon[1:]) + digits, luhn)
    if kind == "phone":
        return canon[:1] + "".join(str(s.below(10)) for _ in canon[1:]) + digits
    if kind == "ssn":
        return "9" + "".join(str(s.below(10)) for _ in canon[1:]) + digits
    if kind == "iban":
        body = "".join(_like(c, s) for c in canon[4:]) + digits
        return canon[:2] + f"{98 - iban_rest(canon[:2] + '00' + body):02d}" + body
    if kind == "secret":
        if re.fullmatch(r"[0-9a-fA-F]+", canon):
            pool = "0123456789ABCDEF" if canon.upper() == canon else "0123456789abcdef"
            return "".join(pool[s.below(16)] for _ in range(len(canon) + longer))
        return "".join(str(s.below(10)) if c.isdigit() else chr((65 if c.isupper() else 97) + s.below(26)) if c.isalpha() else c for c in canon) + digits
    if kind == "given" and canon.isascii():
        pool = GIVEN[gender] if gender in GIVEN else GIVEN["f"] + GIVEN["m"]
        more = "bela" if gender == "f" else "ton"
        return pool[s.below(len(pool))].lower() + ("".join(_like(more[i % len(more)], s) for i in range(len(more) + longer)) if longer else "")
    return "".join(_like(c, s) for c in canon) + "".join(_like(canon[-1], s) for _ in range(longer))


def render(surface: str, kind: str, stand_in: str) -> str:
    """The stand-in in the layout of a mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(stand_in)
        own = "".join(next(chars) if c.isdigit() or kind == "iban" and c != " " else c for c in surface)
        return own + "".join(chars)
    if surface.isupper() and kind != "secret":
        return stand_in.upper()
    if kind in ("given", "surname") and surface[:1].isupper():
        return stand_in[:1].upper() + stand_in[1:]
    return stand_in


def _draw(entities: DataFrame, attempt: int, key: bytes) -> DataFrame:
    def run(batch: pa.RecordBatch):
        cols = [batch.column(i).to_pylist() for i in range(3)]
        return {"kind": cols[0], "canon": cols[1], "stand_in": [surrogate(k, c, g, attempt, key) for k, c, g in zip(*cols)]}

    return arrow(entities.select("kind", "canon", "gender"), run, "kind string, canon string, stand_in string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, gender, n) -> (kind, canon, stand_in): within a kind all stand-ins differ, and none is an entity.

    n counts the mentions of an entity with a gender; most mentions decide.
    """
    if not key:
        raise ValueError("stand-ins need a secret key")
    told = [F.sum(F.when(F.col("gender") == g, F.col("n")).otherwise(0)) for g in "fm"]
    gender = F.when(told[0] + told[1] == 0, "").when(told[0] >= told[1], "f").otherwise("m")
    entities = written(entities.groupBy("kind", "canon").agg(gender.alias("gender")))
    taken, open_, attempt = None, entities, 0
    while True:
        drawn = written(_draw(open_, attempt, key))
        free = drawn.join(entities.select("kind", F.col("canon").alias("stand_in")), ["kind", "stand_in"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "stand_in"), ["kind", "stand_in"], "left_anti")
        won = free.groupBy("kind", "stand_in").agg(F.min("canon").alias("canon")).select("kind", "canon", "stand_in")
        taken = written(won if taken is None else taken.unionByName(won))
        open_ = written(open_.join(taken, ["kind", "canon"], "left_anti"))
        if not open_.limit(1).count():
            return taken
        attempt += 1


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """docs (doc_id, text, ...) with texts rewritten, plus _n_replaced and _kinds (sorted, comma-joined)."""
    docs, schema = added(docs, "_n_replaced long, _kinds string")

    def hits(batch: pa.RecordBatch):
        rows: dict[tuple, int] = {}
        for r1, r2, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for _, _, *entity in find(t):
                rows[r1, r2, *entity] = rows.get((r1, r2, *entity), 0) + 1
        return {name: [r[i] for r in rows] for i, name in enumerate(("r1", "r2", "kind", "canon", "gender"))} | {"n": list(rows.values())} if rows else None

    def row(of: str) -> list:
        return [F.xxhash64(of + "doc_id", of + "text"), F.xxhash64(F.lit(1), of + "text", of + "doc_id")]

    with scope() as keep:
        hit = written(arrow(docs.select(row("")[0].alias("r1"), row("")[1].alias("r2"), "text"), hits, "r1 long, r2 long, kind string, canon string, gender string, n long"))
        chosen = assign(hit, key)
        keep(hit, chosen)
    counted = chosen.join(hit.groupBy("kind", "canon").agg(F.count("*").alias("_n")), ["kind", "canon"])
    maps = hot_join(hit.select("r1", "r2", "kind", "canon"), counted, ["kind", "canon"], "_n", hit.count()).groupBy("r1", "r2").agg(F.collect_set(F.struct("kind", "canon", "stand_in")).alias("_map"))
    same = (row("d.")[0] == F.col("m.r1")) & (row("d.")[1] == F.col("m.r2"))
    joined = docs.alias("d").join(maps.alias("m"), same, "left").select("d.*", F.col("m._map").alias(free(docs, "_map")))
    names, at = docs.columns, docs.columns.index("text")

    def rewrite(batch: pa.RecordBatch):
        texts, n, kinds = [], [], []
        for text, own in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            parts, done, seen = [], 0, []
            if own:
                stand_in = {(r["kind"], r["canon"]): r["stand_in"] for r in own}
                for s, e, kind, canon, _ in find(text):
                    parts += [text[done:s], render(text[s:e], kind, stand_in[kind, canon])]
                    done = e
                    seen.append(kind)
            texts.append("".join([*parts, text[done:]]) if seen else text)
            n.append(len(seen))
            kinds.append(",".join(sorted(set(seen))))
        return dict(zip(names, batch.columns)) | {"text": texts, "_n_replaced": n, "_kinds": kinds}

    return arrow(joined, rewrite, schema)


_keys: dict[str, bytes] = {}


def configured_key(spark: SparkSession) -> bytes:
    """spark.pointlake.pii.key, or a key drawn for this application."""
    told = spark.conf.get("spark.pointlake.pii.key", None)
    return told.encode() if told else _keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = replace_pii(docs, configured_key(spark))
    return found.select("doc_id", "text", F.col("_n_replaced").alias("n_replaced"), F.col("_kinds").alias("kinds"))
