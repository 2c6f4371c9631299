"""Anchors: positions of a byte string chosen by its content, for finding repeated passages.

Of every ``SPAN``-byte window the gram of ``GRAM`` bytes with the smallest hash is an anchor, so
two equal windows have an anchor at the same place in them, whatever surrounds them.
"""

from __future__ import annotations

import numpy as np

from renewal.llm.common import mix64

SPAN, GRAM = 50, 20
SIDE = SPAN - GRAM


def _slide(x: np.ndarray, n: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``n`` neighbours."""
    step, out = 1, x
    while 2 * step <= n:
        out = of(out[:-step], out[step:])
        step *= 2
    return of(out[: len(out) - (n - step)], out[n - step :]) if n > step else out


def gram_hashes(raw: np.ndarray, n: int, places: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of the ``n`` bytes (at least 8) from every place, or from some places."""
    size = len(raw) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(size if places is None else len(places), np.uint64)
        for at in [*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]:
            word = np.ndarray((size,), "<u8", raw.data, at, (1,))  # unaligned loads
            h = (h ^ (word if places is None else word[places])) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram hash) of the anchors of one document's bytes."""
    if len(raw) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(raw, GRAM)
    rank = (h >> np.uint64(32)).astype(np.uint32)
    low = _slide(rank, SIDE + 1, np.minimum)  # the smallest of each window
    pad = np.concatenate([np.zeros(SIDE, np.uint32), low, np.zeros(SIDE, np.uint32)])
    place = np.flatnonzero(rank == _slide(pad, SIDE + 1, np.maximum))  # smallest in some window
    return place, mix64(h[place])
