"""Word and shingle hashes of whole texts, straight from Arrow buffers with numpy.

Words are runs of bytes that are no ASCII white space; A-Z count as a-z. A word's hash is a polynomial over
random 64-bit byte values modulo 2**64, taken from prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word and the end)."""
    raw, off = buffers(col)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edge = off[:-1]
    edge = edge[edge < n]
    first[edge] = solid[edge]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = solid[ends]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[raw] * _power(_BASE, n), out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * _power(_BACK, n)[start])
    return hashes, np.searchsorted(start, off)


_ORDER = _rng.integers(1, 2**63, 8, dtype=np.uint64) * U(2) + U(1)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k-word shingle, each text's first one and the end); a shorter text is one shingle."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.zeros(len(at), np.int64)
    np.cumsum(count, out=to[1:])
    out = np.zeros(to[-1], np.uint64)
    if len(hashes) >= k:
        full = hashes[: len(hashes) - k + 1] * _ORDER[0]
        for j in range(1, k):
            full = full + hashes[j : len(hashes) - k + 1 + j] * _ORDER[j]
        keep = np.ones(len(full), bool)
        for j in range(1, k):  # no shingle crosses from one text to the next
            cut = at[1:-1] - j
            keep[cut[(cut >= 0) & (cut < len(full))]] = False
        owner_long = np.repeat(n >= k, count)
        out[owner_long] = full[keep]
    for i in np.flatnonzero((n > 0) & (n < k)):
        v = U(n[i])
        for j in range(n[i]):
            v = mix(np.array([v ^ hashes[at[i] + j]]) + _ORDER[7])[0]
        out[to[i]] = v
    return mix(out), to


def digest16(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
