"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text gets one space in front and is cut into chunks (spaces with the run that follows, runs of spaces, line feeds);
no piece of the vocabulary holds a space after another character, so no merge crosses a chunk. In a chunk the
agenda takes the adjacent pair with the best score (leftmost of equals) again and again. Each candidate merge, known by
(start, middle, end) in its chunk, is skipped if a keyed hash of seed, the text, the chunk's place in the text and these
places is below `drop`; drop = 0 gives the library's own segmentation. So a word is cut anew at each of its places, in
each text, and every run agrees; equal texts are cut alike.

Characters without a piece, and a literal U+2581, are written as byte pieces, so decoding gives back every text.
Null and empty texts are encoded as no tokens and decode to the empty text. Chunks of up to LONG characters are merged
GROUP at a time in numpy; longer ones by a heap of integers with the same rule (about 80 bytes a character of the chunk,
so a text of 5 MB without a space takes 0.4 GB). Nothing is kept between batches. Empty tables give empty tables; a
column named tokens (decode: decoded) is replaced, other extra columns stay and may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import added, arrow, table

MODEL, SEED, DROP = "/opt/tokenizers/piece_bpe_32k.model", 20240607, 0.1
LONG, GROUP = 48, 4096
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _mix_one(x: int) -> int:
    x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 & _MASK
    x = (x ^ (x >> 27)) * 0x81DADEF4BC2DD44D & _MASK
    return x ^ (x >> 33)


_STEP = 0x9E3779B97F4A7C15


class Codec:
    """One vocabulary: encode(texts) and decode(ids)."""

    def __init__(self, model: str = MODEL, seed: int = SEED, drop: float = DROP):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.limit = np.uint64(min(int(drop * 2.0**64), _MASK))
        self.key = hashlib.blake2b(f"{seed}/{drop}".encode(), digest_size=16).digest()
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-self.score, return_inverse=True)[1].tolist()  # 0 is the best score; equal ones share a rank
        special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.id_of = {p.replace("▁", " "): i for i, p in enumerate(self.pieces) if i not in special}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in special if sp.is_byte(i)}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if i in special else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]
        pairs = {}
        for whole, i in self.id_of.items():
            for cut in range(1, len(whole)):
                a, b = self.id_of.get(whole[:cut]), self.id_of.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pairs = pairs
        self.bits = max(int(len(pairs) * 6).bit_length(), 4)
        self.slot_key, self.slot_id = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        mask = (1 << self.bits) - 1
        for k, i in pairs.items():
            at = (k * 0x9E3779B97F4A7C15 & _MASK) >> (64 - self.bits)
            while self.slot_key[at] >= 0:
                at = (at + 1) & mask
            self.slot_key[at], self.slot_id[at] = k, i
        self.point_id = np.full(0x110000, -2, np.int32)
        for c, i in self.id_of.items():
            if len(c) == 1:
                self.point_id[ord(c)] = i

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of a + b, or -1."""
        key = np.where((a >= 0) & (b >= 0), a << 20 | b, -2)
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        have = self.slot_key[at]
        out = np.where(have == key, self.slot_id[at], -1)
        open_ = np.flatnonzero((have != key) & (have >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            have = self.slot_key[at[open_]]
            hit = have == key[open_]
            out[open_[hit]] = self.slot_id[at[open_[hit]]]
            open_ = open_[~hit & (have >= 0)]
        return out

    def seeds(self, text: str, n: int) -> np.ndarray:
        """A keyed 64-bit hash for each of the n chunks of a text."""
        own = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=self.key).digest(), "little")
        return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(own))

    def kept(self, chunk: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which candidate merges the keyed hash lets through."""
        place = (start.astype(np.uint64) << np.uint64(42)) + (mid.astype(np.uint64) << np.uint64(21)) + end.astype(np.uint64)
        return _mix(chunk + place * np.uint64(_STEP)) >= self.limit

    def kept_one(self, chunk: int, start: int, mid: int, end: int) -> bool:
        place = (start << 42) + (mid << 21) + end & _MASK
        return _mix_one(chunk + place * _STEP & _MASK) >= int(self.limit)

    def _spell(self, ids: list[int], text: str, starts: list[int]) -> bytes:
        out: list[int] = []
        for i, at in zip(ids, starts):
            if i >= 0:
                out.append(i)
            else:
                out += [self.byte_id[b] for b in text[at].encode()]
        return np.array(out, "<i4").tobytes()

    def _many(self, keys: list[str], seeds: np.ndarray) -> list[bytes]:
        """The ids of short chunks, merged many at a time. A symbol is named by its first position, and its end is the next one's."""
        rows, size = len(keys), np.fromiter(map(len, keys), np.int64, len(keys))
        width = int(size.max())
        step = width + 2
        held = np.arange(width)[None, :] < size[:, None]
        points = np.zeros((rows, width), np.uint32)
        points[held] = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = np.full((rows, step), -1, np.int64)
        sym[:, :width] = np.where(held, self.point_id[points], -1)
        end = np.broadcast_to(np.arange(1, step + 1), (rows, step)).copy()
        back = np.broadcast_to(np.arange(-1, step - 1), (rows, step)).copy()
        new, score = np.full((rows, step), -1, np.int64), np.full((rows, step), -np.inf, np.float32)
        flat_sym, flat_end, flat_back, flat_new, flat_score = (x.reshape(-1) for x in (sym, end, back, new, score))

        def offer(row: np.ndarray, i: np.ndarray) -> None:
            """Scores the pair that begins at i of each row anew."""
            base = row * step
            mid = flat_end[base + i]
            found = self.merged(flat_sym[base + i], flat_sym[base + mid])
            level = np.where(found >= 0, self.score[found], -np.inf)
            if self.limit:
                some = np.flatnonzero(found >= 0)
                gone = some[~self.kept(seeds[row[some]], i[some], mid[some], flat_end[base[some] + mid[some]])]
                level[gone] = -np.inf
            flat_new[base + i], flat_score[base + i] = found, level

        row, i = np.nonzero(held[:, 1:])
        if len(row):
            offer(row, i)
        live = np.arange(rows)
        while len(live):
            at = score[live, :width].argmax(1)
            base = live * step
            go = flat_score[base + at] > -np.inf
            live, at, base = live[go], at[go], base[go]
            if not len(live):
                break
            mid = flat_end[base + at]
            stop = flat_end[base + mid]
            flat_sym[base + at], flat_sym[base + mid] = flat_new[base + at], -1
            flat_end[base + at], flat_score[base + mid] = stop, -np.inf
            flat_back[base + stop] = at
            before = flat_back[base + at]
            has = before >= 0
            offer(np.concatenate([live, live[has]]), np.concatenate([at, before[has]]))
        body = sym[:, :width]
        flat = body[body != -1]
        count = (body != -1).sum(1)
        to, raw = np.append(0, np.cumsum(count)).tolist(), flat.astype("<i4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(to, to[1:])]
        for r in np.flatnonzero((body == -2).any(1)):
            at = np.flatnonzero(body[r] != -1)
            out[r] = self._spell(body[r, at].tolist(), keys[r], at.tolist())
        return out

    def _one(self, text: str, seed: int) -> bytes:
        """The same rule for a long chunk: a heap of candidates, each the rank of its piece and the place where it begins."""
        n = len(text)
        sym = array("i", self.point_id[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tobytes())
        left, end = array("i", range(-1, n)), array("i", range(1, n + 1))
        agenda: list[int] = []

        def candidate(i: int) -> int:
            """The piece that the pair at i makes, or -1."""
            j = end[i]
            if j >= n or sym[i] < 0 or sym[j] < 0:
                return -1
            new = self.pairs.get(sym[i] << 20 | sym[j], -1)
            return new if new < 0 or not self.limit or self.kept_one(seed, i, j, end[j]) else -1

        def offer(i: int) -> None:
            new = candidate(i)
            if new >= 0:
                heapq.heappush(agenda, self.rank[new] << 32 | i)

        for i in range(n):
            offer(i)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & 0xFFFFFFFF
            new = candidate(i)  # an entry may be older than a merge at its place
            if new < 0 or self.rank[new] != top >> 32:
                continue
            j = end[i]
            stop = end[j]
            sym[i], sym[j], end[i] = new, -1, stop
            left[stop] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        at = [i for i in range(n) if sym[i] != -1]
        return self._spell([sym[i] for i in at], text, at)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian int32."""
        chunks, seeds, to = [], [np.zeros(0, np.uint64)], [0]
        for text in texts:
            if text:
                own = _CHUNK.findall(" " + text)
                chunks += own
                seeds.append(self.seeds(text, len(own)))
            to.append(len(chunks))
        seed = np.concatenate(seeds)
        if not self.limit:  # nothing depends on the place: each chunk once
            first = {c: i for i, c in enumerate(dict.fromkeys(chunks))}
            done = self._merge(list(first), np.zeros(len(first), np.uint64))
            done = [done[first[c]] for c in chunks]
        else:
            done = self._merge(chunks, seed)
        return [b"".join(done[a:b]) for a, b in zip(to, to[1:])]

    def _merge(self, chunks: list[str], seeds: np.ndarray) -> list[bytes]:
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order, done = np.argsort(size, kind="stable"), [b""] * len(chunks)
        short = int((size <= LONG).sum())
        for at in range(0, short, GROUP):
            rows = order[at : min(at + GROUP, short)]
            for i, ids in zip(rows.tolist(), self._many([chunks[i] for i in rows.tolist()], seeds[rows])):
                done[i] = ids
        for i in order[short:].tolist():
            done[i] = self._one(chunks[i], int(seeds[i]))
        return done

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return raw[1:].decode() if raw else ""


_codecs: dict[tuple, Codec] = {}


def codec(*args) -> Codec:
    """One codec for each Python worker and setting."""
    if args not in _codecs:
        _codecs[args] = Codec(*args)
    return _codecs[args]


def encode(docs: DataFrame, model: str = MODEL, seed: int = SEED, drop: float = DROP) -> DataFrame:
    """docs with `tokens` (array<int>) in place of nothing: all columns stay, one is added."""
    docs, schema = added(docs, "tokens array<int>")
    names, at = docs.columns, docs.columns.index("text")

    def run(batch: pa.RecordBatch):
        ids = codec(model, seed, drop).encode(batch.column(at).to_pylist())
        sizes = np.array([len(x) // 4 for x in ids])
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        return dict(zip(names, batch.columns)) | {"tokens": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)}

    return arrow(docs, run, schema)


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """rows with `tokens` -> the same rows with `decoded`; null tokens give null."""
    tokens, schema = added(tokens, "decoded string")
    names, at = tokens.columns, tokens.columns.index("tokens")

    def run(batch: pa.RecordBatch):
        own = codec(model, SEED, 0.0)
        out = [None if t is None else own.decode(np.array(t, "<i4").tobytes()) for t in batch.column(at).to_pylist()]
        return dict(zip(names, batch.columns)) | {"decoded": out}

    return arrow(tokens, run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Encodes and decodes every text in one pass: counts, digests of ids and of the text read back."""

    def run(batch: pa.RecordBatch):
        own, texts = codec(model, SEED, DROP), batch.column(1).to_pylist()
        ids = own.encode(texts)
        back = [own.decode(x) for x in ids]
        hexed = lambda x: hashlib.sha256(x).hexdigest()
        return {
            "doc_id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hexed(x) for x in ids],
            "decoded_sha256": [hexed(x.encode()) for x in back], "lossless": [x == (t or "") for x, t in zip(back, texts)],
        }

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return arrow(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
