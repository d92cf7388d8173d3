"""Grouping genetic algorithm for one bounded set of items: a plan is an array with each item's bin.

Crossover injects whole well-filled bins of one parent into the other, drops the other's bins that hold
an injected item (so none is there twice), and puts the displaced items back by best fit, long ones
first. Items must come in descending length.
"""

from __future__ import annotations

import numpy as np


def best_fit(lengths: np.ndarray, items: np.ndarray, plan: np.ndarray, free: list[int], cap: int) -> None:
    """Put items into the open bin with the least room that suffices, else into a new one. Changes plan and free."""
    open_bins: list[list[int]] = [[] for _ in range(cap + 1)]
    mask = 0  # bit f: some bin has f free
    for b, f in enumerate(free):
        if f > 0:
            open_bins[f].append(b)
            mask |= 1 << f
    for i, n in zip(items.tolist(), lengths[items].tolist(), strict=True):
        fitting = mask >> n
        if fitting:
            f = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[f].pop()
            if not open_bins[f]:
                mask &= ~(1 << f)
        else:
            b, f = len(free), cap
            free.append(cap)
        plan[i] = b
        free[b] = f - n
        if f > n:
            open_bins[f - n].append(b)
            mask |= 1 << (f - n)


def score(lengths: np.ndarray, plan: np.ndarray, cap: int) -> tuple[int, float]:
    """Fewer bins first; then room gathered in few bins."""
    fill = np.bincount(plan, weights=lengths)
    return -len(fill), float(np.square(fill / cap).sum())


def rebuilt(lengths: np.ndarray, plan: np.ndarray, gone: np.ndarray, cap: int) -> np.ndarray:
    """Without the bins marked in gone (items of bin -1 too): what was there goes back by best fit."""
    stay = (plan >= 0) & ~gone[plan]
    new = np.full(len(plan), -1, np.int64)
    kept, new[stay] = np.unique(plan[stay], return_inverse=True)
    free = (cap - np.bincount(new[stay], weights=lengths[stay], minlength=len(kept))).astype(int).tolist()
    best_fit(lengths, np.flatnonzero(~stay), new, free, cap)
    return new


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, rng: np.random.Generator) -> np.ndarray:
    """Some of b's best-filled bins, whole, into a."""
    fill = np.bincount(b, weights=lengths)
    best = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(best, max(1, len(best) // 2), replace=False)] = True
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    child = np.where(injected, len(hit) + b, np.where(hit[a], -1, a))
    _, child[child >= 0] = np.unique(child[child >= 0], return_inverse=True)
    return rebuilt(lengths, child, np.zeros(int(child.max()) + 2, bool), cap)


def mutation(lengths: np.ndarray, plan: np.ndarray, cap: int, rng: np.random.Generator) -> np.ndarray:
    """Opens the emptiest bins and a few others."""
    fill = np.bincount(plan, weights=lengths)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[: max(1, len(fill) // 20)]] = True
    gone[rng.integers(0, len(fill), max(1, len(fill) // 20))] = True
    return rebuilt(lengths, plan, gone, cap)


def decreasing(lengths: np.ndarray, cap: int, noise: np.ndarray | None = None) -> np.ndarray:
    order = np.arange(len(lengths)) if noise is None else np.argsort(-lengths * (1 + noise), kind="stable")
    plan: np.ndarray = np.full(len(lengths), -1, np.int64)
    best_fit(lengths, order, plan, [], cap)
    return plan


def evolve(lengths: np.ndarray, cap: int, seed: list[int], immigrants: list[np.ndarray], population: int, generations: int) -> np.ndarray:
    """The island's elite after some generations; it ends early when no plan can have fewer bins and an epoch brought no gain."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // cap)
    plans = [*immigrants] or [decreasing(lengths, cap)]
    while len(plans) < population:
        plans.append(decreasing(lengths, cap, rng.normal(0, 0.05, len(lengths))))
    ranked = sorted(((score(lengths, p, cap), k, p) for k, p in enumerate(plans)), key=lambda x: (x[0], -x[1]), reverse=True)
    born = len(ranked)
    for _ in range(generations):
        if -ranked[0][0][0] <= least:
            break
        i, j = sorted(rng.integers(0, len(ranked), 2).tolist())
        child = crossover(lengths, ranked[i][2], ranked[j][2], cap, rng) if i < j else mutation(lengths, ranked[i][2], cap, rng)
        born += 1
        ranked.append((score(lengths, child, cap), born, child))
        ranked = sorted(ranked, key=lambda x: (x[0], -x[1]), reverse=True)[:population]
    return ranked[0][2]
