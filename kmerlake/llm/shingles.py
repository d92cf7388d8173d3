"""Distinct word shingles of documents, and their SuperMinHash signatures.

SuperMinHash (Ertl, 2017) gives every element one random number and one slot per step of a random
permutation of the slots; a slot keeps the smallest step + number. A document is done as soon as no slot
can still get smaller, which for a set larger than the signature is after two or three steps.
"""

from __future__ import annotations

import numpy as np

from kmerlake.llm.textkit import U64, mix, owners, rolling

SHINGLE = 5
SLOTS = 128
ROWS = 4  # slots to a band
FULL = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(h: np.ndarray, of: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, of): each document's distinct k-word shingles, ascending; fewer words make one shingle, no words none."""
    doc = owners(of)
    x = rolling(h, k)
    inside = doc[: len(x)] == doc[len(doc) - len(x) :]
    x, where = x[inside], doc[: len(x)][inside]
    count = np.diff(of)
    for c in range(1, k):
        short = np.flatnonzero(count == c)
        y = np.full(len(short), c, U64)
        for i in range(c):
            y = mix(y * U64(0xA0761D6478BD642F) + h[of[short] + i])
        x, where = np.concatenate([x, y]), np.concatenate([where, short])
    order = np.argsort(where, kind="stable")
    x, at = x[order], np.searchsorted(where[order], np.arange(len(of)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[at[:-1][at[:-1] < len(x)]] = True
    return x[new], np.concatenate([[0], np.cumsum(new)])[at]


def signatures(x: np.ndarray, of: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row of slots for each document; a value's high 16 bits are the step, the others the random number."""
    sig = np.full((len(of) - 1, slots), FULL, U64)
    flat, doc, perm = sig.reshape(-1), owners(of), np.empty(0, np.uint8)
    active = np.ones(len(of) - 1, bool)
    for j in range(slots):
        if j:
            active &= sig.max(1, initial=0) >= U64(j << 48)
            on = active[doc]
            if not on.any():
                break
            if j == 1:
                perm = np.tile(np.arange(slots, dtype=np.uint8), (int(on.sum()), 1))
                perm[np.arange(len(perm)), place[on]] = 0
            elif not on.all():
                perm = perm[on]
            if not on.all():
                x, doc = x[on], doc[on]
        rnd = mix(x + U64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((rnd & U64(0xFFFF)) * U64(slots - j) >> U64(16)).astype(np.int64)
        if not j:
            place = k
        else:
            each = np.arange(len(x))
            place = perm[each, k].astype(np.int64)
            perm[each, k] = perm[:, j]
        np.minimum.at(flat, doc * slots + place, (rnd >> U64(16)) | U64(j << 48))
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's slots and its number."""
    groups = sig.reshape(len(sig), -1, rows)
    h = np.broadcast_to(np.arange(groups.shape[1], dtype=U64), groups.shape[:2]).copy()
    for i in range(rows):
        h = mix(h * U64(0xD6E8FEB86659FD93) + groups[:, :, i])
    return h


def odd_sketch(x: np.ndarray) -> np.ndarray:
    """Parities of how many hashes fall on each bit, four bits or more an element, as 64-bit words.

    Two sketches of one width differ in at most as many bits as their sets differ in elements. The upper
    half of a sketch folded onto the lower by exclusive or is the sketch of half the width.
    """
    bits = 1 << max(10, int(4 * len(x) - 1).bit_length() if len(x) else 0)
    count = np.bincount((x & U64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view("<u8")


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def fingerprints(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that together name a set."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(x ^ U64(salt)), dtype=U64)])
        out.append(total[of[1:]] - total[of[:-1]])
    return out[0], out[1]
