"""Hashes of the words of a text, as arrays."""

from __future__ import annotations

import numpy as np

_BYTE = np.uint64(0x9E3779B97F4A7C15)
MIX, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


_powers = np.zeros(0, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(n, _BYTE, np.uint64))
    return _powers[:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, by sums of bytes times powers."""
    codes = np.frombuffer(raw, np.uint8)
    solid = np.concatenate([[False], ~_SPACE[codes], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers = _powers_to(len(codes) + 1)
    # the power of a byte counts from the end of its word
    at = np.repeat(ends, ends - starts)
    inside = np.flatnonzero(solid[1:-1])
    parts = (codes[inside].astype(np.uint64) + np.uint64(1)) * powers[at - inside - 1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts)])
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    return mixed(sums[total[1:]] - sums[total[:-1]])
