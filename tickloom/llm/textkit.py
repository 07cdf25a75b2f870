"""Vectorised words and word hashes over batches of byte strings."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 2**64))
        done += more
    return out


_POW = {"up": _powers(_BASE, 1 << 16), "down": _powers(_INV, 1 << 16)}


def _grown(kind: str, n: int) -> np.ndarray:
    if len(_POW[kind]) < n:
        _POW[kind] = _powers(_BASE if kind == "up" else _INV, n)
    return _POW[kind][:n]


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts joined by a blank, starts and ends of words there, and first[i]: words before text i."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return joined, starts, ends, np.searchsorted(starts, at)


def word_hashes(texts: list[bytes], lower: bool = False, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, text after text, and first[i]: words before text i (len(texts) + 1 numbers).

    A word's hash is a polynomial over random odd numbers for its bytes, taken from prefix
    sums, so that no Python object is made for a word; it is the same in every process.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    joined, starts, ends, first = word_spans(texts)
    out = np.empty(len(starts), np.uint64)
    table = _BYTE[_LOWER] if lower else _BYTE
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + block, "right")))
        hi = ends[j - 1]
        n = int(hi - lo)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[joined[lo:hi]] * _grown("up", n), out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * _grown("down", n)[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out, first


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h (len(h) - k + 1 numbers)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= np.uint64(0xC6A4A7935BD1E995)
        acc += h[i : i + n]
    return mix(acc)
