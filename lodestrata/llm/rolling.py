"""Rolling hashes of words and runs of words over a text's bytes, in arrays: no word object is built."""

from __future__ import annotations

import numpy as np

_BASE, _STIR = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
#: What each byte counts in the hash of a word.
_LETTER = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n - 1; the largest tables made so far are kept."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _TABLES[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _TABLES[0][:n], _TABLES[1][:n]


def word_codes(plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of a text in which blanks (byte 32) part words."""
    raw = np.frombuffer(plain, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    up, down = _powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * up, dtype=np.uint64)))
    code = (sums[ends] - sums[starts]) * down[starts]
    return starts, ends, stirred(code)


def stirred(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits of the given ones."""
    h = (h ^ (h >> np.uint64(32))) * _STIR
    return h ^ (h >> np.uint64(29))


def rolling(code: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, from the words' hashes."""
    if len(code) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(code))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * up, dtype=np.uint64)))
    return (sums[size:] - sums[:-size]) * down[: len(code) - size + 1]
