"""Vectorised hashing of k-mers: MurmurHash3 (x64, 128 bits, its first half), seed 42, of the canonical
k-mer's letters, which is what public k-mer signature files hold."""

from __future__ import annotations

import numpy as np

_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i
_LETTER = np.frombuffer(b"ACGT", np.uint8)
#: k-mers that are hashed at once.
_CHUNK = 1 << 18
SEED = 42

U = np.uint64
# The multipliers of the hash.
_C1, _C2 = U(0x87C37B91114253D5), U(0x4CF5AD432745937F)
_F1, _F2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * _F1
    x = (x ^ (x >> U(33))) * _F2
    return x ^ (x >> U(33))


def murmur3(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The hash of each row of bytes; all rows are of one length."""
    n, size = rows.shape
    pad = np.zeros((n, -(-size // 16) * 16), np.uint8)
    pad[:, :size] = rows
    words = pad.view("<u8")
    with np.errstate(over="ignore"):
        h1, h2 = np.full(n, seed, U), np.full(n, seed, U)
        for i in range(size // 16):
            h1 = h1 ^ _turn(words[:, 2 * i] * _C1, 31) * _C2
            h1 = (_turn(h1, 27) + h2) * U(5) + U(0x52DCE729)
            h2 = h2 ^ _turn(words[:, 2 * i + 1] * _C2, 33) * _C1
            h2 = (_turn(h2, 31) + h1) * U(5) + U(0x38495AB5)
        if size % 16:  # what is left, filled up with zeros: a zero word changes nothing
            h2 = h2 ^ _turn(words[:, -1] * _C2, 33) * _C1
            h1 = h1 ^ _turn(words[:, -2] * _C1, 31) * _C2
        h1, h2 = h1 ^ U(size), h2 ^ U(size)
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _final(h1), _final(h2)
        return h1 + h2


def _first(forward: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Per row, whether `forward` is not after `back` in the alphabet."""
    differ = forward != back
    at = differ.argmax(axis=1)
    rows = np.arange(len(forward))
    return forward[rows, at] <= back[rows, at]


def canonical_kmer_hashes(bases: str, k: int) -> np.ndarray:
    """64-bit hashes of the lesser of each k-mer and its reverse complement; k-mers with other letters are left out."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    code = _CODE[np.frombuffer(bases.encode("ascii", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, U)
    bad = np.concatenate([[0], np.cumsum(code == 255)])
    starts = np.flatnonzero(bad[k:] == bad[:-k])
    windows = np.lib.stride_tricks.sliding_window_view(code, k)
    out = [np.empty(0, U)]
    for i in range(0, len(starts), _CHUNK):
        forward = windows[starts[i : i + _CHUNK]]
        back = 3 - forward[:, ::-1]
        out.append(murmur3(_LETTER[np.where(_first(forward, back)[:, None], forward, back)]))
    return np.concatenate(out)


def most(scaled: int) -> int:
    """The greatest hash that a sketch of density 1 / scaled keeps."""
    return round(2**64 / scaled) if scaled > 1 else 2**64 - 1
