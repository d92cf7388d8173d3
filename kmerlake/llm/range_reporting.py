"""Points in rectangles: a wavelet tree over a permutation, kept by levels, for many rectangles at a time."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """values[i] is the height of the point at place i; heights are 0 to n - 1, each once.

    Level p splits every node's points, in their order, by bit p of the height. Of each level only the ones before
    each place are kept; the nodes of a level lie side by side, all zeros before all ones.
    """

    def __init__(self, values: np.ndarray):
        self.levels = max(len(values) - 1, 0).bit_length()
        self.ones, self.zeros = [], []
        x = np.asarray(values, np.int32)
        for p in reversed(range(self.levels)):
            bit = (x >> np.int32(p) & np.int32(1)).astype(bool)
            before = np.zeros(len(x) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(x) - int(before[-1]))
            x = np.concatenate([x[~bit], x[bit]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, height) of every point with left <= place < right and low <= height < high, for all rectangles.

        All go down together; those whose node has no point left, or none of their heights, are out.
        """
        which = np.flatnonzero((right > left) & (high > low))
        a, b, base = left[which], right[which], np.zeros(len(which), np.int64)
        for i in range(self.levels):
            half = 1 << (self.levels - 1 - i)
            oa, ob = self.ones[i][a].astype(np.int64), self.ones[i][b].astype(np.int64)
            down = (ob - oa < b - a) & (low[which] < base + half)
            up = (ob > oa) & (high[which] > base + half)
            # of a node, what lies beyond its heights has been left out before
            down &= high[which] > base
            up &= low[which] < base + 2 * half
            a, b = np.concatenate([(a - oa)[down], (self.zeros[i] + oa)[up]]), np.concatenate([(b - ob)[down], (self.zeros[i] + ob)[up]])
            base = np.concatenate([base[down], (base + half)[up]])
            which = np.concatenate([which[down], which[up]])
        return which, base
