"""Content-chosen anchors of byte strings: the sampled suffixes of a sparse suffix array.

Of any ``LENGTH`` consecutive bytes the leftmost smallest hash of a ``GRAM``-byte substring
is an anchor, so equal strings of that length hold the same anchor at the same place.
"""
from __future__ import annotations

import numpy as np

from .shared import mix64

LENGTH, GRAM = 100, 32
LEFT = LENGTH - GRAM                     # an anchor lies at most this deep in its string
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEPS = [np.uint64(pow(0x9FB21C651E98DF25 | 1, 1 << k, 1 << 64)) for k in range(8)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM``-byte substrings by doubling (GRAM is a power of two)."""
    h = _BYTE[data]
    size, k = 1, 0
    while size < GRAM:
        h = h[:-size] * _STEPS[k] + h[size:]
        size, k = 2 * size, k + 1
    return h


def prefix_hashes(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    acc = np.empty(len(data) + 1, np.uint64)
    acc[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=acc[1:])
    return acc


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions of one text (bytes) and their hashes; none below ``LENGTH`` bytes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mix64(_gram_hashes(data))
    window = LENGTH - GRAM + 1
    # leftmost minimum of each window: minima of blocks, doubled; ties keep the left one
    low, size = h, 1
    while 2 * size <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = window - size
    low = np.minimum(low[:len(low) - rest], low[rest:]) if rest else low      # window minima
    # position i is an anchor if it is the leftmost minimum of some window that holds it
    m = len(low)
    at = np.flatnonzero(_is_anchor(h, low, window, m))
    return at, h[at]


def _is_anchor(h: np.ndarray, low: np.ndarray, window: int, m: int) -> np.ndarray:
    out = np.zeros(len(h), bool)
    # the first window's leftmost minimum, then every change of the leftmost minimum
    cand = np.flatnonzero(_near_minimum(h, low, window, m))
    last = -1
    hs = h[cand]
    # next smaller-or-equal to the left decides from which window on a candidate is leftmost
    prev = np.full(len(cand), -1, np.int64)          # last candidate at the left with hash <= own
    stack: list[int] = []
    lo = hs.tolist()
    for i, x in enumerate(lo):
        while stack and lo[stack[-1]] > x:
            stack.pop()
        prev[i] = cand[stack[-1]] if stack else -1
        stack.append(i)
    first = np.maximum(np.maximum(cand - window + 1, prev + 1), 0)
    ok = first <= np.minimum(cand, m - 1)
    ok &= low[np.minimum(first, m - 1)] == hs
    out[cand[ok]] = True
    return out


def _near_minimum(h: np.ndarray, low: np.ndarray, window: int, m: int) -> np.ndarray:
    """Whether each position equals the minimum of any window that holds it: the largest of
    those minima is compared."""
    pad = np.zeros(window - 1, np.uint64)
    ext = np.concatenate([pad, low, pad])
    size, high = 1, ext
    while 2 * size <= window:
        high = np.maximum(high[:-size], high[size:])
        size *= 2
    rest = window - size
    high = np.maximum(high[:len(high) - rest], high[rest:]) if rest else high
    return high[:len(h)] == h


def text_anchors(data: np.ndarray, up: np.ndarray, down: np.ndarray, piece: int = 1 << 19):
    """``(position, gram hash, context hash)`` of one text's anchors. The context are all
    bytes that share a ``LENGTH``-byte string with the anchor. Long texts go in pieces that
    overlap by a string, so memory follows the piece; the anchors are those of the whole."""
    n = len(data)
    parts = []
    for lo in range(0, max(n - LENGTH + 1, 0), piece):
        hi = min(n, lo + piece + LENGTH - 1)
        at, h = anchors(data[lo:hi])
        at = at + lo
        b0, b1 = max(0, lo - LEFT), min(n, hi + LENGTH)
        acc = prefix_hashes(data[b0:b1], up)
        s, e = np.maximum(at - LEFT, 0) - b0, np.minimum(at + LENGTH, n) - b0
        c = mix64((acc[e] - acc[s]) * down[s] + mix64(((e - s) * 1009 + (at - b0 - s)).astype(np.uint64)))
        parts.append((at, h, c))
    if not parts:
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), z, z
    if len(parts) == 1:
        return parts[0]
    at, h, c = (np.concatenate(x) for x in zip(*parts))
    at, first = np.unique(at, return_index=True)
    return at, h[first], c[first]
