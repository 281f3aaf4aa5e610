"""Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes and their 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = 4096
_M = np.uint64(0xD6E8FEB86659FD93)


def mix(z: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _series(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = [_series(256, 11), _series(256, 22)]
_POS = [_series(_TABLE, 33), _series(_TABLE, 44)]
_ONES = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def spans(data: bytes, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and each word's start and end in them. gaps: which bytes stand between words."""
    a = np.frombuffer(data, np.uint8)
    word = np.zeros(len(a) + 2, bool)
    np.logical_not(gaps[a], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return a, edges[::2], edges[1::2]


def word_hashes(data: bytes, families: int = 1, gaps: np.ndarray = _SPACE) -> list[np.ndarray]:
    """For each of 1 or 2 independent hash families, a 64-bit hash of each word of data."""
    a, starts, ends = spans(data, gaps)
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in range(families)]
    lengths = ends - starts
    kept = a[~gaps[a]]
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    out = []
    for k in range(families):
        at = _POS[k] if longest <= _TABLE else _series(longest, (33, 44)[k])
        out.append(mix(np.add.reduceat(_BYTE[k][kept] * at[place], first)))
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_ONES[0]) < n:
        m = max(n, 8192)
        inverse = pow(int(_M), -1, 2**64)
        up, down = np.full(m, _M, np.uint64), np.full(m, np.uint64(inverse), np.uint64)
        up[0] = down[0] = 1
        _ONES[0], _ONES[1] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _ONES[0][:n], _ONES[1][:n]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])
