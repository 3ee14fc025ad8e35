"""Numpy helpers for word-shingle sets: hashing, HyperMinHash registers, exact set comparison."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
import xxhash

U = np.uint64
GOLD, M1, M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Word hashes remembered by a worker before it starts afresh (bounds its memory, not its results).
CACHE = 300_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed on first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a word-hash sequence; fewer words: the sequence as one."""
    n = len(h)
    if not n:
        return h
    size = min(n, k)
    out = np.full(n - size + 1, U(size))
    for j in range(size):
        out = out * GOLD + h[j : n - size + 1 + j]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that name a set, whatever its order."""
    return np.array([mix(s ^ GOLD).sum(dtype=U), mix(s + M1).sum(dtype=U)]).tobytes()


#: HyperMinHash: REGISTERS buckets, each a leading-zero count (6 bits) and MANTISSA bits after the first one.
REGISTERS, MANTISSA, ROWS = 128, 10, 4
_BITS = U(REGISTERS.bit_length() - 1)
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=U) * GOLD)


def registers(s: np.ndarray) -> np.ndarray:
    """The compressed registers of a set, 16 bits each.

    One hash deals each shingle to a bucket, which keeps its least value; a bucket that stays empty takes the
    least value under a hash of its own. So each register is a min-wise choice for sets of any size.
    """
    x = np.sort(mix(s ^ M2))
    b = (x >> (U(64) - _BITS)).astype(np.int64)
    first = np.concatenate(([True], b[1:] != b[:-1]))
    low = np.zeros(REGISTERS, U)
    low[b[first]] = x[first]
    empty = np.ones(REGISTERS, bool)
    empty[b[first]] = False
    for at in np.array_split(np.flatnonzero(empty), max(1, empty.sum() * len(s) // 500_000)):
        if len(at):
            low[at] = mix(s[None, :] ^ _SEEDS[at][:, None]).min(axis=1)
    frac, exp = np.frexp((low << _BITS).astype(np.float64))
    zeros = np.clip(64 - exp, 0, 63)
    mant = np.clip(((frac - 0.5) * 2 ** (MANTISSA + 1)).astype(np.int64), 0, 2**MANTISSA - 1)
    return (zeros << MANTISSA | mant).astype(np.uint16)


def estimate(equal, size_a, size_b):
    """Jaccard estimate from the share of equal registers, less what chance makes equal; numbers or arrays.

    Two independent minima of about lam values each fall in one cell with probability sum(p^2) over its cells.
    """
    lam = np.atleast_1d((np.asarray(size_a, float) + size_b) / (2 * REGISTERS))[:, None]
    zeros = np.arange(0, 40)
    p = np.exp(-lam * 2.0 ** -(zeros + 1)) - np.exp(-lam * 2.0**-zeros)
    chance = (p**2).sum(axis=1) / 2**MANTISSA
    return (equal - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, exactly, for sorted distinct arrays."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def pieces(column, most: int = 8_000_000):
    """Index ranges of an Arrow binary column that hold about `most` bytes each (one value at least)."""
    start, size = 0, 0
    for i, x in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        size += x
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column)
