"""Edit distance of patterns to places in a text, row by row in numpy."""

from __future__ import annotations

import numpy as np


def edits(pattern: np.ndarray, text: np.ndarray, most: int) -> int:
    """The fewest edits that make pattern a part of text, or most + 1."""
    col = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        new = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (text != c)]))
        row = np.minimum.accumulate(new - col) + col
        if row.min() > most:
            return most + 1
    return int(row.min())


def banded(patterns: np.ndarray, text: np.ndarray, at: np.ndarray, width: int, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """For each row of patterns (without zero bytes), the fewest edits that make it a part of text[low:high] on the `width` diagonals from place `at` on; -1 beyond `most`."""
    n = patterns.shape[1]
    place = at + np.arange(n + width - 1)[:, None]
    near = np.where((place >= low) & (place < high), text[np.clip(place, 0, len(text) - 1)], 0).astype(np.uint8)
    p = np.ascontiguousarray(patterns.T)
    out = np.full(len(at), -1)
    alive = np.arange(len(at))
    col = np.arange(width, dtype=np.int8)[:, None]
    row = np.zeros((width, len(at)), np.int8)  # n and width are well below 127
    for i in range(n):
        new = row + (near[i : i + width] != p[i])
        np.minimum(new[:-1], row[1:] + np.int8(1), out=new[:-1])
        new -= col
        row = np.minimum.accumulate(new, axis=0) + col
        if i % 16 == 15:
            good = row.min(0) <= most
            if 4 * good.sum() < 3 * len(good):
                row, near, p, alive = row[:, good], near[:, good], p[:, good], alive[good]
    best = row.min(0)
    out[alive[best <= most]] = best[best <= most]
    return out
