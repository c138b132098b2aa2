"""Word and shingle hashes of a text, in numpy with no loop over words.

A word's hash is a polynomial of random numbers that stand for its bytes,
modulo 2^64, from differences of running sums; a shingle's mixes those of its words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BYTES = np.random.default_rng(20_240_517).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_R = 0xD1342543DE82EF95
_R_INVERSE = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i for i below n at least; the tables double as longer texts come."""
    while len(_powers[0]) < n:
        for k, r in enumerate((_R, _R_INVERSE)):
            t = _powers[k]
            _powers[k] = np.concatenate([t, t * _U(pow(r, len(t), 1 << 64))])
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """One number for each word of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of fewer words the whole sequence is one; none without words."""
    w = word_hashes(text)
    n = min(size, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = mix(h * _U(0x9E3779B97F4A7C15) + w[k : k + len(h)])
    return np.unique(h)
