"""Word shingles of whole texts as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, _U(base), dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes other than \\x20 and \\x09-\\x0D, in order."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.uint64)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[b]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers_to(len(b))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: the whole sequence as one; none: empty."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    size = min(k, len(w))
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        h = np.full(n, _U(size), dtype=np.uint64)
        for j in range(size):
            h = h * _U(0xD6E8FEB86659FD93) + w[j : j + n]
    return np.unique(mix(h))


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b)) if len(a) else 0
