"""Word-shingle sets and circulant MinHash signatures, in numpy on a text's UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, U)
    out[1:] = U(_BASE)
    return np.multiply.accumulate(out)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word (run of other than ASCII white space) with A-Z lower-cased, in order.

    Long texts are taken in segments that end at white space, so memory is bounded by the longest word.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.empty(0, U)
    buf = _LOWER[np.frombuffer(data, np.uint8)]
    space = _SPACE[buf]
    out, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + _SEGMENT)
        if end < len(buf):
            tail = np.flatnonzero(space[at:end])
            while not len(tail) and end < len(buf):
                end = min(len(buf), end + _SEGMENT)
                tail = np.flatnonzero(space[at:end])
            if len(tail) and end < len(buf):
                end = at + int(tail[-1]) + 1
        out.append(_segment(buf[at:end], space[at:end]))
        at = end
    return np.concatenate(out)


def _segment(buf: np.ndarray, space: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U)
    lengths = ends - starts
    inside = buf[~space].astype(U) + U(1)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    size = 1 << max(6, int(lengths.max()).bit_length())
    return mix(np.add.reduceat(inside * _powers(size)[place], first) + mix(lengths.astype(U)))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a text of fewer words is one shingle as a whole, one without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    h = mix(w[:n] + U(k))
    for t in range(1, k):
        h = mix(h * U(0x9FB21C651E98DF25) + w[t : t + n])
    return np.unique(h)


class CirculantMinHash:
    """Two permutations: sigma spreads shingles over the positions of a ring, pi is a fixed random
    permutation of the ring. Coordinate j of a signature is the least pi, turned by j, over a set's
    positions; so one run of pi from each position holds what all coordinates need."""

    def __init__(self, rows: int, bands: int, ring_bits: int = 20, seed: int = 1):
        self.rows, self.bands, self.size = rows, bands, rows * bands
        ring = 1 << ring_bits
        pi = np.random.default_rng(seed).permutation(ring).astype(np.uint32)
        self._runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: self.size]]), self.size)
        self._shift, self._seed = U(64 - ring_bits), U(seed * 0x632BE59BD9B4E019 % 2**64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = np.unique(mix(shingles ^ self._seed) >> self._shift)
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(at), 1024):
            np.minimum(out, self._runs[at[i : i + 1024]].min(axis=0), out=out)
        return out

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key a band; keys of different bands differ. No keys for an empty set."""
        if not len(shingles):
            return np.empty(0, np.int64)
        sig = self.signature(shingles).reshape(self.bands, self.rows).astype(U)
        h = mix(np.arange(1, self.bands + 1, dtype=U))
        for j in range(self.rows):
            h = mix(h * U(0x9FB21C651E98DF25) + sig[:, j])
        return h.view(np.int64)


@lru_cache(maxsize=4)
def circulant(rows: int, bands: int, seed: int = 1) -> CirculantMinHash:
    return CirculantMinHash(rows, bands, seed=seed)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)
