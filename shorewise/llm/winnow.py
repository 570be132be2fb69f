"""Winnowing: the anchors that any two copies of a window choose alike."""

from __future__ import annotations

import numpy as np

_PLACE = np.uint64((1 << 26) - 1)


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams, the place of the least one (of equal ones the last)."""
    return anchors_of(grams, [width])[0]


def anchors_of(grams: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    """anchors for several widths, found by one doubling."""
    if len(grams) > int(_PLACE) and len(grams) >= min(widths):
        raise ValueError("too long a chunk")
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(widths)
    low, span = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64)), 1
    for k in sorted(range(len(widths)), key=lambda k: widths[k]):
        width, n = widths[k], len(grams) - widths[k] + 1
        if n < 1:
            break
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        least = np.minimum(low[:n], low[width - span : width - span + n])
        out[k] = (_PLACE - (least & _PLACE)).astype(np.int64)
    return out


def inside(lengths: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of the n places of joined sequences begin a window that ends in the same sequence."""
    ok, ends = np.ones(n, dtype=bool), np.cumsum(lengths)
    for a, b in zip(np.maximum(ends - window + 1, ends - lengths), ends, strict=True):
        ok[a:b] = False
    return ok


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Places that a window beginning at one of the starts covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + window, n), -1)
    return np.cumsum(step)[:n] > 0
