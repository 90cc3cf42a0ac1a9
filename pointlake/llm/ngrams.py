"""Language-model scoring with a trigram model whose n-grams lie in Elias-Fano tries.

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end after each text; a token's two predecessors are
its context, with start marks before the first. Words are known by 64-bit hashes. Smoothing interpolates by absolute
discounting: p3 = (c3 - D) / C(ab) + D T(ab) / C(ab) p2, p2 = (c2 - D) / C(b) + D T(b) / C(b) p1, p1 = (c + 0.5) / (N + 0.5 (V + 1)), with C the
tokens and T the distinct tokens seen after a context; a context never seen passes on to the shorter one. Every n-gram of the
training rows is in the model, none is cut off, so it grows with the input.

The model is dealt into shards of about SHARD_BYTES of text by a context's last word b: everything that a token's score needs lies in
one shard. A shard is a trie, each level in Elias-Fano form in a memory-mapped file (eliasfano.py): words; roots b; the successors w
of b, with quantised probabilities; the contexts (a, b) under b, with quantised back-off weights; and the successors of each context, held as
places among the successors of b (context-relative), made one ascending sequence by monotone pointers. A token is looked
up by finding its place among the successors of b and then searching that place among those of (a, b).

Work in steps, each over all rows: (1) words and pairs that are frequent in some block of text are counted; those above half a shard
are hot. A hot word's contexts are spread over several shards by their first word, a hot pair's tokens by their place, so no key loads
a task; what these shards can't count themselves (pairs of a hot word, triples of a hot pair) comes from step 2, which is
aggregated in every task before it is dealt out. (2) word counts over all training rows, dealt by hash; each word's count goes to the shards that
need it. (3) All tokens, packed by block and shard, meet that in their shard: it counts the training n-grams, builds its trie,
and scores all tokens. Sums come back by block and row, in whole numbers, so
they don't depend on the order of tasks. Shards, blocks and hash ranges have bounded sizes, by the bytes of all text; a row of
any length is one block, read as a whole. Broadcast are only the hot words and pairs, fewer than 8 for each shard.

Null text is empty: one end token. Rows without a doc_id are scored but not learned from in op12. Rows of one doc_id are scored one by
one. Without training rows V and N are 0 and every token has probability 1. Empty tables give no rows. Only the key, the text
and the columns in `learn` are read, so others may have any name. Quantising (1/4096 of a decimal digit) moves a score by at most
0.0004 a token; base scores are exact but for 1e-9 a token. Two words with one hash would be one word (about 1e-6 likely among ten million words).
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import bounded, sliced, table, written
from pointlake.llm.eliasfano import Levels
from pointlake.llm.wordhash import U, mix, words

SHARD_BYTES, BLOCK, DISCOUNT, STEPS = 16 << 20, 1 << 22, 0.75, 4096
#: Base scores are summed in whole numbers of this part of a decimal digit.
FINE = 1 << 30
#: Marks in place of words before a text's first and after its last; no word's hash but by chance.
START, END = U(0x5374617274), U(0x456E64)
_G = U(0x9E3779B97F4A7C15)
_VOCABULARY, _PAIRS, _TRIPLES, _TOKENS = range(4)
_ROW = "shard int, kind int, block long, docs binary, data binary"


# ---- packing ----


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string: whole numbers in the fewest bytes that hold them, uint64 (ascending hashes) as differences,
    all of them byte by byte, so that bytes of one weight stand together."""
    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype.itemsize > 1 and a.dtype != np.uint64:
            top = int(a.max()) if len(a) else 0
            a = a.astype(np.min_scalar_type(top) if top < 1 << 32 else np.int64)
        elif a.dtype == np.uint64:
            a = np.diff(a, prepend=U(0))
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if a.dtype.kind in "iu" else np.ascontiguousarray(a)
        out.append(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 4, []
    for _ in range(struct.unpack_from("<i", raw)[0]):
        kind, n = struct.unpack_from("<2sq", raw, at)
        kind = np.dtype(kind.decode())
        a = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 10)
        a = np.ascontiguousarray(a.reshape(kind.itemsize, n).T).view(kind).reshape(n) if kind.kind in "iu" else a.view(kind)
        out.append(np.cumsum(a, dtype=np.uint64) if kind == np.uint64 else a)
        at += 10 + n * kind.itemsize
    return out


# ---- tokens of a block ----


class Block:
    """Tokens of some rows: their hashes with marks between rows (sequence), the tokens' places there (at) and rows; after index() the ascending
    distinct hashes, and for each token its place among them (w) and those of the two before it (a, b)."""

    def __init__(self, keys: list[pa.Array], learn: list[np.ndarray], rows: list[tuple[np.ndarray, np.ndarray]]):
        self.keys, self.learn = pa.concat_arrays(keys), np.concatenate(learn)
        lengths = np.concatenate([n for _, n in rows])
        first = np.cumsum(lengths + 3) - lengths - 3
        seq = np.empty(int(lengths.sum()) + 3 * len(lengths), np.uint64)
        inner = np.ones(len(seq), bool)
        seq[first] = seq[first + 1] = START
        seq[first + lengths + 2] = END
        inner[first] = inner[first + 1] = inner[first + lengths + 2] = False
        seq[inner] = np.concatenate([h for h, _ in rows])
        inner[first + lengths + 2] = True
        at = np.flatnonzero(inner)
        self.sequence, self.at = seq, at
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)

    def index(self) -> Block:
        """With the distinct hashes and the tokens' places among them."""
        code, found = pd.factorize(self.sequence)
        order = np.argsort(found)
        place = np.empty(len(found), np.int32)
        place[order] = np.arange(len(found))
        of, at = place[code], self.at
        del code, self.sequence, self.at
        self.hashes, self.a, self.b, self.w = found[order], of[at - 2], of[at - 1], of[at]
        return self


def blocks(batches):
    """Blocks of about BLOCK tokens from record batches (key, text, learn); a longer row is a block of its own."""
    keys, learn, rows, size = [], [], [], 0
    for batch in batches:
        for part in sliced(batch) if batch.num_rows else []:
            h, at = words(part.column(1))
            keys.append(part.column(0))
            learn.append(part.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool))
            rows.append((h, np.diff(at)))
            size += len(h) + part.num_rows
            if size >= BLOCK:
                block = Block(keys, learn, rows)
                keys, learn, rows, size = [], [], [], 0
                yield block
                del block
    if keys:
        yield Block(keys, learn, rows)


# ---- shards ----


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _G + b)


class Layout:
    """Where tokens go: shard by b; hot words by b and some of a, hot pairs by place."""

    def __init__(self, shards: int, hot_words: dict[int, int], hot_pairs: dict[tuple[int, int], int]):
        """hot_words, hot_pairs: the number of shards that each is spread over."""
        self.shards = shards
        self.words = np.array(sorted(hot_words), np.uint64)
        self.ways = np.array([hot_words[int(x)] for x in self.words], np.uint64)
        pairs = sorted((int(_pair(np.array([a], np.uint64), np.array([b], np.uint64))[0]), b, k, a) for (a, b), k in hot_pairs.items())
        self.pair_words = [(x[3], x[1]) for x in pairs]
        self.pairs = np.array([x[0] for x in pairs], np.uint64)
        self.pair_ways = np.array([x[2] for x in pairs], np.uint64)
        self.word_shards = [self._spread(w, int(k)) for w, k in zip(self.words, self.ways)]
        self.pair_shards = [self._spread(p, int(k)) for p, k in zip(self.pairs, self.pair_ways)]
        # a hot word's pairs are wanted wherever its tokens go, those of its hot pairs included
        self.wanted = [np.unique(np.concatenate([s, *[self.pair_shards[j] for j, x in enumerate(pairs) if U(x[1]) == w]])) for w, s in zip(self.words, self.word_shards)]

    def _spread(self, key, ways: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.unique(mix(U(key) + np.arange(ways, dtype=np.uint64) * _G) % U(self.shards)).astype(np.int64)

    @staticmethod
    def rank(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The place of each x in keys, -1 where it isn't there."""
        if not len(keys):
            return np.full(len(x), -1, np.int64)
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[i] == x, i, -1)

    def deal(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, hot word, hot pair: its place or -1) of every token."""
        u, n = block.hashes, U(self.shards)
        shard = (mix(u + U(7)) % n).astype(np.int32)[block.b]
        if not len(self.words):
            return shard, *[np.broadcast_to(np.int32(-1), len(shard))] * 2
        hot, pair = self.rank(self.words, u).astype(np.int32)[block.b], np.full(len(shard), -1, np.int32)
        at = np.flatnonzero(hot >= 0)
        if len(at):
            a, b = u[block.a[at]], u[block.b[at]]
            shard[at] = mix(b + mix(a + U(3)) % self.ways[hot[at]] * _G) % n
            pair[at] = self.rank(self.pairs, _pair(a, b))
            of = at[pair[at] >= 0]
            way = mix((of >> 6).astype(np.uint64) + u[block.a[of]]) % self.pair_ways[pair[of]]
            shard[of] = mix(self.pairs[pair[of]] + way * _G) % n
        return shard, hot, pair


def _layout(rows: DataFrame, shard_bytes: int) -> Layout:
    """Shards by the bytes of all texts; hot are words and pairs with half a shard's tokens (6 bytes each) or more."""
    size = rows.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
    shards, least = max(1, -(-size // shard_bytes)), max(shard_bytes // 12, 2)
    if shards == 1:
        return Layout(1, {}, {})
    share = 1 / (4 * shards)  # a key with twice that share of all tokens has it in some blocks that hold most of its tokens

    def run(batches):
        for block in blocks(batches):
            before = block.sequence[block.at - 1]
            low = max(2, int(share * len(before)))
            w, n = np.unique(before, return_counts=True)
            w, n = w[n >= low], n[n >= low]
            of = Layout.rank(w, before)
            at = np.flatnonzero(of >= 0)
            pair, first, m = np.unique(_pair(block.sequence[block.at[at] - 2], before[at]), return_index=True, return_counts=True)
            at = at[first[m >= low]]
            a, b, m = block.sequence[block.at[at] - 2], before[at], m[m >= low]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(len(w), np.int32), np.ones(len(m), np.int32)])), *[pa.array(np.concatenate(x).view(np.int64)) for x in ((w * U(0), a), (w, b))], pa.array(np.concatenate([n, m]))],
                names=["kind", "a", "b", "n"],
            )

    found = rows.mapInArrow(run, "kind int, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    ways = lambda n: min(shards, 2 * n // least)
    u = lambda x: x & (2**64 - 1)
    hot = {u(r["b"]): ways(r["n"]) for r in found if r["kind"] == 0}
    return Layout(shards, hot, {(u(r["a"]), u(r["b"])): ways(r["n"]) for r in found if r["kind"] == 1 and u(r["b"]) in hot})


# ---- counts ----


def _counts(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows for the shards with the counts that they can't make: of words, of pairs of hot words, of triples of hot pairs; words and tokens of
    each hash range in the columns `distinct` and `total`."""
    held = rows.sparkSession.sparkContext.broadcast(layout)

    def run(batches):
        to = held.value
        for block in blocks(batches):
            out = []
            shard, hot, pair = to.deal(block.index())
            train = block.learn[block.row]
            u, of = block.hashes, block.w
            n = np.bincount(of, train, len(u)).astype(np.int64)
            wants = [_distinct(of[pair < 0].astype(np.int64) * to.shards + shard[pair < 0], len(u) * to.shards)]
            for j in np.unique(pair[pair >= 0]):  # tokens after a hot pair may go to any of its shards
                wants.append((np.unique(of[pair == j]).astype(np.int64)[:, None] * to.shards + to.pair_shards[j]).ravel())
            want = np.unique(np.concatenate(wants)) if len(wants) > 1 else wants[0]
            word = want // to.shards
            part = (mix(u + U(11)) % U(to.shards)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.diff(part[order], prepend=-1))
            starts, ends = np.searchsorted(word, np.arange(len(u))), np.searchsorted(word, np.arange(len(u)), "right")
            for lo, hi in zip(edge, [*edge[1:], len(order)]):
                at = np.sort(order[lo:hi])
                each = ends[at] - starts[at]
                places = np.repeat(starts[at] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                out.append((int(part[at[0]]), _VOCABULARY, _pack(u[at], n[at], each, want[places] % to.shards)))
            for kind, chosen in ((_PAIRS, hot), (_TRIPLES, pair)):
                at = np.flatnonzero((chosen >= 0) & train)
                if len(at):
                    key = chosen[at].astype(np.int64) * len(u) + of[at]
                    key, m = np.unique(key, return_counts=True)
                    w = u[key % len(u)]
                    p = (mix(w + U(13)) % U(to.shards)).astype(np.int64)
                    for x in np.unique(p):
                        mine = p == x
                        out.append((int(x), kind, _pack(key[mine] // len(u), w[mine], m[mine])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], names=["part", "kind", "data"])

    def merge(group: pa.Table) -> pa.Table:
        to, got = held.value, {k: [] for k in range(3)}
        for kind, data in zip(group["kind"].to_pylist(), group["data"].to_pylist()):
            got[kind].append(_unpack(data))
        u, of = np.unique(np.concatenate([x[0] for x in got[_VOCABULARY]] or [np.zeros(0, np.uint64)]), return_inverse=True)
        n = np.bincount(of, np.concatenate([x[1] for x in got[_VOCABULARY]]) if len(u) else None, len(u)).astype(np.int64)
        out = []
        if len(u):
            each, to_shard = np.concatenate([x[2] for x in got[_VOCABULARY]]).astype(np.int64), np.concatenate([x[3] for x in got[_VOCABULARY]]).astype(np.int64)
            known = np.repeat(of, each)
            want = np.unique((to_shard * len(u) + known)[n[known] > 0])
            s = want // len(u)
            for lo, hi in _runs(s):
                at = want[lo:hi] % len(u)
                out.append((int(s[lo]), _VOCABULARY, _pack(u[at], n[at])))
        for kind, targets in ((_PAIRS, to.wanted), (_TRIPLES, to.pair_shards)):
            if got[kind]:
                key, w, m = (np.concatenate([x[i] for x in got[kind]]) for i in range(3))
                uw, at = np.unique(w, return_inverse=True)
                both, at = np.unique(key.astype(np.int64) * len(uw) + at, return_inverse=True)
                m, w, key = np.bincount(at, m).astype(np.int64), uw[both % len(uw)], both // len(uw)
                for lo, hi in _runs(key):
                    out += [(int(s), kind, _pack(key[lo : lo + 1], w[lo:hi], m[lo:hi])) for s in targets[key[lo]]]
        rows_of = [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]
        k = len(out) + 1  # one more row with the range's own figures
        return pa.table({
            "shard": pa.array([*rows_of[0], None], pa.int32()), "kind": pa.array([*rows_of[1], None], pa.int32()), "data": pa.array([*rows_of[2], None], pa.binary()),
            "distinct": pa.array([None] * (k - 1) + [int((n > 0).sum())], pa.int64()), "total": pa.array([None] * (k - 1) + [int(n.sum())], pa.int64()),
        })

    found = rows.mapInArrow(run, "part int, kind int, data binary")
    return found.groupBy("part").applyInArrow(merge, "shard int, kind int, data binary, distinct long, total long")


def _distinct(keys: np.ndarray, top: int) -> np.ndarray:
    """Distinct ascending keys below top: by marks where these take no more room than the keys, else by sorting."""
    if top > 8 * len(keys):
        return np.unique(keys)
    seen = np.zeros(top, bool)
    seen[keys] = True
    return np.flatnonzero(seen)


def _runs(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return list(zip(edge.tolist(), [*edge[1:].tolist(), len(sorted_keys)]))


# ---- a shard ----


def _tokens(rows: DataFrame, layout: Layout) -> DataFrame:
    """All tokens, a row for each block and shard: distinct hashes, places of a, b and w among them, the row of each token (as the
    difference to the one before), and whether the model learns from each of these rows."""
    held = rows.sparkSession.sparkContext.broadcast(layout)

    def run(batches):
        from pyspark import TaskContext

        to, number = held.value, TaskContext.get().partitionId() << 32
        for block in blocks(batches):
            number += 1
            shard, _, _ = to.deal(block.index())
            order = np.argsort(shard.astype(np.min_scalar_type(to.shards)), kind="stable")
            keys = block.keys.to_numpy(zero_copy_only=False) if not block.keys.null_count else None
            ids = [np.array([k is None for k in block.keys.to_pylist()], bool), np.array(block.keys.fill_null(0).to_numpy(), np.int64) if keys is None else keys]
            header = _pack(ids[0], np.diff(ids[1].astype(np.int64), prepend=0).view(np.uint64))
            first, place_of = True, np.zeros(len(block.hashes), np.int32)
            for lo, hi in _runs(shard[order]):
                at = order[lo:hi]
                places = [x[at] for x in (block.a, block.b, block.w)]
                own = _distinct(np.concatenate(places), len(block.hashes))
                place_of[own] = np.arange(len(own))
                row = block.row[at]
                data = _pack(block.hashes[own], *[place_of[x] for x in places], np.diff(row, prepend=0), block.learn[row[np.flatnonzero(np.diff(row, prepend=-1))]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[at[0]])], pa.int32()), pa.array([_TOKENS], pa.int32()), pa.array([number]), pa.array([header if first else None], pa.binary()), pa.array([data], pa.binary())],
                    names=["shard", "kind", "block", "docs", "data"],
                )
                first = False

    return rows.mapInArrow(run, _ROW)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys with the sum of n of each."""
    edge = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(n, edge) if len(edge) else n[:0]


def _levels_of(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65535).astype(np.uint16)


class Trie:
    """The n-grams of a shard. ids are places in the shard's ascending word hashes; triples (a, b, w) come ascending by b, a, w."""

    def __init__(self, hashes, counts, pairs, triples, tokens: int, distinct: int, discount: float = DISCOUNT):
        """counts: of each word; pairs (b, w, n) and triples (a, b, w, n) with distinct ascending keys (b, w) and (b, a, w)."""
        self.v, self.mass = len(hashes), tokens + 0.5 * (distinct + 1)
        v = max(self.v, 1)
        pb, pw, pn = pairs
        ta, tb, tw, tn = triples
        roots, total = _sums(pb, pn)
        start = np.searchsorted(pb, roots)
        kinds = np.diff(start, append=len(pb))
        r = np.repeat(np.arange(len(roots)), kinds)
        back = discount * kinds / np.maximum(total, 1)
        p2 = (pn - discount) / total[r] + back[r] * ((counts[pw] + 0.5) / self.mass)
        succ = r * v + pw
        del r
        tr = np.searchsorted(roots, tb)
        place = np.searchsorted(succ, tr * v + tw)  # of (b, w) among all successors
        third = place - start[tr]
        lower = p2[place]
        del place
        key = tr * v + ta
        ctx, ctotal = _sums(key, tn)
        ckinds = np.diff(np.searchsorted(key, ctx), append=len(ta))
        del key
        c = np.repeat(np.arange(len(ctx)), ckinds)
        cback = discount * ckinds / np.maximum(ctotal, 1)
        p3 = _levels_of((tn - discount) / ctotal[c] + cback[c] * lower)
        del lower
        cptr = np.searchsorted(ctx // v, np.arange(len(roots) + 1))
        base = np.concatenate([[0], np.cumsum(np.diff(cptr) * kinds)])
        third += base[tr]
        third += (c - cptr[tr]) * kinds[tr]
        del c, tr
        u = lambda x: x.astype(np.uint64)
        self.levels = Levels(
            {"words": hashes, "counts": u(np.concatenate([[0], np.cumsum(counts)])), "roots": u(roots), "succ": u(succ), "succ_at": u(np.append(start, len(pb))), "ctx": u(ctx), "ctx_at": u(cptr), "base": u(base), "third": third.view(np.uint64)},
            {"p2": _levels_of(p2), "back": _levels_of(back), "p3": p3, "cback": _levels_of(cback)},
        )

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ascending hashes, -1 for unknown ones."""
        return self.levels.sequence("words").find(hashes)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by ascending ids (-1: 0)."""
        seq, known = self.levels.sequence("counts"), ids >= 0
        out = np.zeros(len(ids), np.int64)
        at = ids[known]
        out[known] = (seq.get(at + 1) - seq.get(at)).astype(np.int64)
        return out

    def score(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """-log10 probability, in STEPS, of each token w after a, b, ids ascending by b, a, w (-1 first); p1: that of w alone."""
        v, ls = max(self.v, 1), self.levels

        def each(fn, keys: np.ndarray) -> np.ndarray:
            """fn of every distinct one of the ascending keys, given to all that have it; -1 for keys below 0."""
            edge = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
            of, known = keys[edge], keys[edge] >= 0
            out = np.full(len(of), -1, np.int64)
            out[known] = fn(of[known])
            return np.repeat(out, np.diff(edge, append=len(keys)))

        r = each(ls.sequence("roots").find, b)
        ctx = np.full(len(w), -1, np.int64)
        ok = np.flatnonzero((r >= 0) & (a >= 0))
        ctx[ok] = each(ls.sequence("ctx").find, r[ok] * v + a[ok])
        succ = np.full(len(w), -1, np.int64)
        ok = np.flatnonzero((r >= 0) & (w >= 0))
        if len(ok):
            key, of = np.unique(r[ok] * v + w[ok], return_inverse=True)
            succ[ok] = ls.sequence("succ").find(key)[of]
        third = np.full(len(w), -1, np.int64)
        ok = np.flatnonzero((ctx >= 0) & (succ >= 0))
        if len(ok):
            ro = r[ok]
            at = lambda name, shift=0: each(lambda k: ls.sequence(name).get(k + shift).astype(np.int64), ro)
            s0 = at("succ_at")
            third[ok] = ls.sequence("third").find(at("base") + (ctx[ok] - at("ctx_at")) * (at("succ_at", 1) - s0) + succ[ok] - s0)
        level = lambda name, i: np.where(i >= 0, ls.plain(name)[np.maximum(i, 0)] if len(ls.plain(name)) else 0, 0).astype(np.int64)
        low = np.where(succ >= 0, level("p2", succ), p1 + level("back", r))
        return np.where(third >= 0, level("p3", third), low + level("cback", ctx))


def _shard(group: pa.Table, layout: Layout, tokens: int, distinct: int) -> list[tuple]:
    """(block, docs, sums) for each block of the shard."""
    got = {k: [] for k in range(4)}
    for i in range(group.num_rows):
        kind, block, docs, data = (group[c][i].as_py() for c in ("kind", "block", "docs", "data"))
        got[kind].append((block, docs, _unpack(data)))
    if not got[_TOKENS]:
        return []
    given = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in zip(*((d[0], d[1].astype(np.uint64)) for _, _, d in got[_VOCABULARY]))] or [np.zeros(0, np.uint64)] * 2
    local = [d for _, _, d in got[_TOKENS]]
    hot_ends = [layout.words[[int(d[0][0]) for _, _, d in got[_PAIRS]]], np.array([x for _, _, d in got[_TRIPLES] for x in layout.pair_words[int(d[0][0])]], np.uint64)]
    hashes, of = np.unique(np.concatenate([given[0], *[d[0] for d in local], *[d[1] for k in (_PAIRS, _TRIPLES) for _, _, d in got[k]], *hot_ends]), return_inverse=True)
    v = len(hashes)
    counts = np.zeros(v, np.int64)
    counts[of[: len(given[0])]] = given[1].astype(np.int64)
    of = of.astype(np.int32)
    place = np.cumsum([len(given[0]), *[len(d[0]) for d in local]])
    ids = [of[i:j] for i, j in zip(place[:-1], place[1:])]
    a, b, w = (np.concatenate([x[d[k]] for x, d in zip(ids, local)]) for k in (1, 2, 3))
    rows_of = [np.cumsum(d[4], dtype=np.int32) for d in local]
    train = np.concatenate([d[5][np.cumsum(d[4] > 0) - (d[4][0] > 0)] for d in local])
    heads = [(block, docs) for block, docs, _ in got.pop(_TOKENS)]
    del of, ids, local
    # every distinct triple once, ascending by b, a, w
    if v < 1 << 21:
        key, at = np.unique((b.astype(np.int64) * v + a) * v + w, return_inverse=True)
        c, tw = _parts(key, v)
        del key
        tb, ta = _parts(c, v)
    else:  # three places don't fit a long
        context, c = np.unique(b.astype(np.int64) * v + a, return_inverse=True)
        key, at = np.unique(c * v + w, return_inverse=True)
        c, tw = _parts(key, v)
        tb, ta = _parts(context[c], v)
        del key, context
    at, tb = at.astype(np.int32), tb.astype(np.int32)
    del a, b, c
    n = np.bincount(at, train, len(tw)).astype(np.int32)
    del train
    # n-grams that other shards share in are counted elsewhere
    find = lambda h: np.searchsorted(hashes, h)
    mine = n > 0
    if len(layout.pairs):
        mine &= Layout.rank(layout.pairs, _pair(hashes[ta], hashes[tb])) < 0
    triples = [x[mine] for x in (ta, tb, tw, n)]
    for _, _, (j, tail, m) in got[_TRIPLES]:
        first, last = layout.pair_words[int(j[0])]
        triples = [np.append(x, y) for x, y in zip(triples, (np.full(len(tail), find(U(first))), np.full(len(tail), find(U(last))), find(tail), m))]
    if got[_TRIPLES]:
        triples = _ascending(triples, (1, 0, 2))
    hot = Layout.rank(layout.words, hashes) >= 0
    own = ~hot[triples[1]]
    bw, bn = _sums(*_sorted_by(triples[1][own].astype(np.int64) * v + triples[2][own], triples[3][own]))
    pairs = [bw // v, bw % v, bn]
    for _, _, (j, tail, m) in got[_PAIRS]:
        pairs = [np.append(x, y) for x, y in zip(pairs, (np.full(len(tail), find(layout.words[int(j[0])])), find(tail), m))]
    if got[_PAIRS]:
        pairs = _ascending(pairs, (0, 1))
    trie = Trie(hashes, counts, pairs, triples, tokens, distinct)
    del pairs, triples, mine, own
    counts = trie.counts(np.arange(v))
    p1 = np.rint((np.log10(trie.mass) - np.log10(counts + 0.5)) * STEPS).astype(np.int64)
    costs = trie.score(ta, tb, tw, p1[tw])
    del ta, tb, tw
    fine, unknown, out, i = np.rint(np.log10(2 * counts + 1) * FINE).astype(np.int64), (counts == 0).astype(np.int64), [], 0
    for (block, docs), row in zip(heads, rows_of):
        edge = np.flatnonzero(np.diff(row, prepend=-1))
        own = w[i : i + len(row)]
        each = [np.add.reduceat(y, edge) for y in (costs[at[i : i + len(row)]], fine[own], unknown[own])]
        out.append((block, docs, _pack(np.diff(row[edge], prepend=0), np.diff(edge, append=len(row)), *each)))
        i += len(row)
    return out


def _parts(key: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotient, and remainder as a 32-bit place."""
    high = key // v
    return high, (key - high * v).astype(np.int32)


def _sorted_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    return key[order], n[order]


def _ascending(columns: list[np.ndarray], by: tuple[int, ...]) -> list[np.ndarray]:
    order = np.lexsort([columns[k] for k in reversed(by)])
    return [np.asarray(x, np.int64)[order] for x in columns]


def score(docs: DataFrame, learn: Column, key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs (key, text, ...) -> (key, n_tokens, n_known, train_tokens, base_score, score) for every row; the model learns from the
    rows where `learn` is true."""
    bounded(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    layout = _layout(rows, shard_bytes)
    counts = written(_counts(rows, layout))
    of_all = counts.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    distinct, total = of_all["v"] or 0, of_all["n"] or 0
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    held = docs.sparkSession.sparkContext.broadcast((layout, total, distinct))

    def shard(group: pa.Table) -> pa.Table:
        found = _shard(group, *held.value)
        return pa.table({"block": pa.array([x[0] for x in found], pa.int64()), "docs": pa.array([x[1] for x in found], pa.binary()), "data": pa.array([x[2] for x in found], pa.binary())})

    def combine(group: pa.Table) -> pa.Table:
        nil, step = _unpack(next(x for x in group["docs"].to_pylist() if x is not None))
        sums = np.zeros((4, len(nil)), np.int64)  # tokens, cost, fine, unknown
        for data in group["data"]:
            gap, *each = _unpack(data.as_py())
            row = np.cumsum(gap, dtype=np.int64)
            for total_of, x in zip(sums, each):
                total_of[row] += x.astype(np.int64)
        n, cost, fine, unknown = sums
        base = fine / FINE - n * (np.log10(2) + norm)
        return pa.table({"key": pa.array(np.cumsum(step.view(np.int64)), pa.int64(), mask=nil.astype(bool)), "n_tokens": n, "n_known": n - unknown, "base_score": base, "score": cost / -STEPS})

    dealt = counts.where("shard IS NOT NULL").select("shard", "kind", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("docs"), "data")
    parts = _tokens(rows, layout).unionByName(dealt).groupBy("shard").applyInArrow(shard, "block long, docs binary, data binary")
    out = parts.groupBy("block").applyInArrow(combine, "key long, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), ~held_out())
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
