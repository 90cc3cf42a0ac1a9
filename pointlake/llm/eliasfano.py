"""Monotone sequences in Elias-Fano form, kept in one memory-mapped file and read in ascending batches.

A value's lowest bits are stored packed; its high part in unary, as a one for every value and a zero after every high part.
Positions of every SAMPLE-th zero and one are kept beside them, so a batch of ascending keys decodes only the window of
bits that its high parts span.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

SAMPLE, CHUNK = 512, 1 << 16
U = np.uint64


def packed(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a sequence of ascending uint64 values (equal ones may follow each other)."""
    n = len(values)
    v = values.astype(np.uint64, copy=False)
    top = int(v[-1]) if n else 0
    width = min(max((top // max(n, 1)).bit_length() - 1, 0), 56)
    high = (v >> U(width)).astype(np.int64)
    ends = int(high[-1]) + 1 if n else 1
    bits = np.zeros(n + ends, np.uint8)
    bits[high + np.arange(n)] = 1
    low = [np.zeros(0, np.uint8)]
    at = np.arange(width, dtype=np.uint64)
    for i in range(0, n if width else 0, 8 * 4096):  # a multiple of eight values fills whole bytes
        part = (v[i : i + 8 * 4096, None] >> at).astype(np.uint8) & np.uint8(1)
        low.append(np.packbits(part.ravel(), bitorder="little"))
    return {
        "head": np.array([n, width, ends, len(bits)], np.int64), "low": _words(np.concatenate(low)), "high": np.packbits(bits, bitorder="little"),
        "zeros": np.flatnonzero(bits == 0)[::SAMPLE].astype(np.int64), "ones": np.flatnonzero(bits)[::SAMPLE].astype(np.int64),
    }


def _words(data: np.ndarray) -> np.ndarray:
    """Bytes as 64-bit words, with one word more at the end."""
    return np.concatenate([data, np.zeros(8 + -len(data) % 8, np.uint8)]).view("<u8")


class Monotone:
    """Reads a packed sequence; keys and ranks are given in ascending order."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.width, self.ends, self.bits = (int(x) for x in parts["head"])
        self.low, self.high, self.zeros, self.ones = (parts[k] for k in ("low", "high", "zeros", "ones"))
        self.mask = U((1 << self.width) - 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        out |= (self.low[word + 1] << U(1)) << (U(63) - shift)
        return out & self.mask

    def _places(self, first: int, last: int, bit: int) -> tuple[np.ndarray, int]:
        """(places of the zeros or ones with ranks from `start` up to at least `last`, start)."""
        index = self.ones if bit else self.zeros
        begin = int(index[first // SAMPLE]) >> 3
        stop = last // SAMPLE + 1
        end = int(index[stop]) + 1 if stop < len(index) else self.bits
        window = np.unpackbits(self.high[begin : -(-end // 8)], bitorder="little")[: end - 8 * begin]
        found = np.flatnonzero(window == bit) + 8 * begin
        skip = np.searchsorted(found, index[first // SAMPLE])  # bits of the first byte before the sample
        return found[skip:], first // SAMPLE * SAMPLE

    def get(self, rank: np.ndarray) -> np.ndarray:
        """The values at ascending ranks."""
        out = np.empty(len(rank), np.uint64)
        for i in range(0, len(rank), CHUNK):
            r = rank[i : i + CHUNK]
            place, start = self._places(int(r[0]), int(r[-1]), 1)
            high = (place[r - start] - r).astype(np.uint64)
            out[i : i + CHUNK] = (high << U(self.width)) | (self._low(r) if self.width else U(0))
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each of the ascending keys, -1 where there is none; values are distinct."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n:
            return out
        for i in range(0, len(keys), CHUNK):
            k = keys[i : i + CHUNK].astype(np.uint64)
            h = (k >> U(self.width)).astype(np.int64)
            m = int(np.searchsorted(h, self.ends))  # beyond the last high part there is nothing
            if not m:
                break
            k, h = k[:m], h[:m]
            zero, start = self._places(max(int(h[0]) - 1, 0), int(h[-1]), 0)
            low = np.where(h > 0, zero[np.maximum(h - 1 - start, 0)] + 1 - h, 0)
            end = zero[h - start] - h
            if not self.width:
                out[i : i + m] = np.where(low < end, low, -1)
                continue
            target, high = k & self.mask, end.copy()
            active = np.flatnonzero(low < high)
            while len(active):
                mid = (low[active] + high[active]) >> 1
                less = self._low(mid) < target[active]
                low[active[less]] = mid[less] + 1
                high[active[~less]] = mid[~less]
                active = active[low[active] < high[active]]
            at = np.flatnonzero(low < end)
            at = at[self._low(low[at]) == target[at]]
            out[i + at] = low[at]
        return out


class Levels:
    """Named arrays in one file without a name, memory-mapped; Elias-Fano sequences are several arrays under one name."""

    def __init__(self, sequences: dict[str, np.ndarray], plain: dict[str, np.ndarray]):
        self.at: dict[str, tuple[int, int, np.dtype]] = {}
        fd, path = tempfile.mkstemp()
        size = 0
        with os.fdopen(fd, "wb") as f:
            for name, a in ((n, a) for s, v in sequences.items() for n, a in ((f"{s}.{k}", x) for k, x in packed(v).items())):
                size = self._put(f, name, a, size)
            for name, a in plain.items():
                size = self._put(f, name, a, size)
        self.bytes = size
        self.file = np.memmap(path, np.uint8, "r") if size else np.zeros(0, np.uint8)
        os.unlink(path)  # the mapping keeps it until it is dropped

    def _put(self, f, name: str, a: np.ndarray, size: int) -> int:
        data = np.ascontiguousarray(a).tobytes()
        f.write(data + bytes(-len(data) % 8))
        self.at[name] = size, len(data), a.dtype
        return size + len(data) + -len(data) % 8

    def plain(self, name: str) -> np.ndarray:
        start, n, kind = self.at[name]
        return np.asarray(self.file[start : start + n]).view(kind)

    def sequence(self, name: str) -> Monotone:
        return Monotone({k: self.plain(f"{name}.{k}") for k in ("head", "low", "high", "zeros", "ones")})
