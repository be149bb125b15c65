"""Hashed word shingles of whole texts, vectorized over a text's bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(0x51)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads each bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16, 2 * len(_powers[0]))
        with np.errstate(over="ignore"):
            for at, base in ((0, _BASE), (1, _BACK)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[at] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word of a UTF-8 text: the runs of bytes other than ASCII white space."""
    b = np.frombuffer(raw, np.uint8)
    space = np.concatenate([[True], _SPACE[b], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(b))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[b] * up)])
        return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_set(text: str | None, k: int, lower: bool = True) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the k-word shingles; of a shorter text, one hash of all its words."""
    raw = (text or "").encode()
    w = word_hashes(raw.lower() if lower else raw)  # bytes.lower() changes A-Z only
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        if len(w) < k:
            h = np.array([len(w)], np.uint64)
            for x in w:
                h = mix(h * _BASE + x)
            return h
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = mix(h * _BASE + w[j : j + n])
    return np.unique(h)
