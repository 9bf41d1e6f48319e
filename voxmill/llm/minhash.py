"""Circulant MinHash signatures (Li and Li, 2021): two permutations give every coordinate.

A shingle is a point of [0, 2^32). The first permutation scatters the points;
the second one, shifted circularly by i, gives coordinate i as its minimum. Both
are fixed bijections of 32-bit integers, so nothing is stored or sent.
"""

from __future__ import annotations

import numpy as np

from .words import MULTIPLIER, mix64

#: The first permutation's offset.
FIRST = np.uint64(0x5851F42D4C957F2D)


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place: a bijection of 32-bit integers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def scatter(shingle: np.ndarray) -> np.ndarray:
    return (mix64(shingle + FIRST) >> np.uint64(32)).astype(np.uint32)


def circulant(shingle: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """``(len(starts), coordinates)`` minima over the shingles from each start to the next; no set may be empty."""
    out = np.empty((len(starts), coordinates), dtype=np.uint32)
    if len(starts):
        first = scatter(shingle)
        for i in range(coordinates):
            out[:, i] = np.minimum.reduceat(_permute(first - np.uint32(i)), starts)
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """``(sets, bands)`` 64-bit bucket names, different for each band."""
    n, k = signature.shape
    wide = signature[:, : k - k % rows].reshape(n, k // rows, rows).astype(np.uint64)
    name = np.arange(k // rows, dtype=np.uint64)[None, :] * MULTIPLIER + np.uint64(rows)
    for r in range(rows):
        name = mix64(name + wide[:, :, r] * MULTIPLIER)
    return name
