"""Exchange clustering of units into classes, for one bounded table of bigram counts.

The objective is the log-likelihood of the class bigrams: the sum of x log x over the cells of the class
table, less that over its row and column sums. A move's gain is exact, given that all other units stay.
"""

from __future__ import annotations

import numpy as np


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def objective(table: np.ndarray) -> float:
    return float(_f(table).sum() - _f(table.sum(1)).sum() - _f(table.sum(0)).sum())


def class_counts(units: np.ndarray, n: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(classes[units], weights=n, minlength=size)


def best_class(own: int, right: np.ndarray, left: np.ndarray, itself: float, table: np.ndarray, choices: int) -> tuple[int, float]:
    """The class of 0 to choices - 1 that gains most, and its gain over staying. right, left: the unit's counts by class of the neighbour; itself: with itself."""
    r, l_, t = right.astype(float), left.astype(float), table.astype(float).copy()
    r[own] -= itself
    l_[own] -= itself
    t[own] -= r
    t[:, own] -= l_
    t[own, own] -= itself
    b = np.arange(choices)
    rows, cols = t[:choices], t[:, :choices].T
    by_row = _f(rows + r) - _f(rows)
    by_col = _f(cols + l_) - _f(cols)
    gain = by_row.sum(1) - by_row[b, b] + by_col.sum(1) - by_col[b, b]
    at = t[b, b]
    gain += _f(at + r[b] + l_[b] + itself) - _f(at)
    # the other classes' sums have their pairs with the unit wherever it goes
    out, into = (t.sum(1) + l_)[:choices], (t.sum(0) + r)[:choices]
    gain -= _f(out + r.sum() + itself) - _f(out) + _f(into + l_.sum() + itself) - _f(into)
    to = int(gain.argmax())
    return to, float(gain[to] - gain[own])
