"""Gear rolling hash over whole buffers in numpy, and content-defined cut points."""

from __future__ import annotations

import numpy as np

#: Bytes that one hash value depends on: a 32-bit gear hash has shifted a byte out after 32 more.
WINDOW = 32


def _gear_table(seed: int = 0x9E3779B9) -> np.ndarray:
    """256 pseudo-random 32-bit values from a multiplicative mixing rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(seed)) & np.uint64(0xFFFFFFFF)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return x.astype(np.uint32)


GEAR = _gear_table()


def gear_hashes(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """h[i]: sum of GEAR[data[i - j]] << j modulo 2^32 over j < window (a power of two), by doubling.

    With all 32 terms this is h[i] = (h[i-1] << 1) + GEAR[data[i]].
    """
    h = GEAR[data]
    k = 1
    while k < window:
        if len(h) > k:
            h[k:] += h[:-k] << np.uint32(k)
        k *= 2
    return h


def mask_cuts(data: np.ndarray, bits: int) -> np.ndarray:
    """Chunk ends (exclusive) where the top ``bits`` bits are zero: one in 2^bits positions, none in the first WINDOW bytes."""
    cuts = np.flatnonzero(gear_hashes(data) < np.uint32(1 << (32 - bits))) + 1
    return cuts[cuts >= WINDOW]


def peaks(data: np.ndarray, radius: int, window: int) -> np.ndarray:
    """Positions whose hash is the single largest within ``radius`` on both sides.

    A peak depends on the bytes near it alone: those from ``radius + window - 1`` before to ``radius`` after it. So an
    insertion moves no peak elsewhere, peaks lie more than ``radius`` apart, and periodic text has none.
    """
    n, size = len(data), 2 * radius + 1
    if n < size:
        return np.empty(0, np.int64)
    h = gear_hashes(data, window)
    top, width = h, 1
    while width * 2 <= size:  # running maximum over ``size`` by doubling
        top = np.maximum(top[:-width], top[width:])
        width *= 2
    if width < size:
        top = np.maximum(top[: n - size + 1], top[size - width :])
    at = np.flatnonzero(h[radius : n - radius] == top) + radius
    near = np.diff(at) <= radius  # equal maxima within reach of each other: neither is the single largest
    return at[~(np.r_[near, False] | np.r_[False, near])] if len(at) else at
