"""The syncmer kernel: whole Arrow batches of sequences to selected k-mers, in numpy.

A window of w = k - s + 1 s-mers is selected if its middle s-mer has the window's least rank (ties
included, so strands never disagree); its k-mer's canonical form is the value. Windows with anything but
ACGT are skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BASES = 1 << 20
TABLE_S = 9  # up to this s the order comes from a table of all s-mers

_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84]] = range(4)
_LETTERS = np.frombuffer(b"ACGT", np.uint8)
WIDE = pa.decimal128(38, 0)
_orders: dict[tuple[str, int], np.ndarray] = {}


def _reversed_code(x: np.ndarray, s: int) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(s):
        out = out << x.dtype.type(2) | (x & x.dtype.type(3) ^ x.dtype.type(3))
        x = x >> x.dtype.type(2)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def order_table(order: str, s: int) -> np.ndarray:
    """Rank of every packed s-mer; those of either strand share one."""
    if (order, s) not in _orders:
        codes = np.arange(4**s, dtype=np.uint32)
        least = np.minimum(codes, _reversed_code(codes, s))
        own = np.unique(least)
        if order == "md5":
            letters = np.stack([_LETTERS[own >> np.uint32(2 * i) & np.uint32(3)] for i in reversed(range(s))], 1)
            hashes = np.array([int(hashlib.md5(m.tobytes(), usedforsecurity=False).hexdigest()[:15], 16) for m in letters], np.uint64)
        else:
            hashes = own.astype(np.uint64) if order == "lex" else _mix(own)
        _, rank = np.unique(hashes, return_inverse=True)
        full = np.zeros(4**s, np.uint32)
        full[own] = rank
        _orders[order, s] = full[least]
    return _orders[order, s]


def _seeds() -> np.ndarray:
    """32 bits for each base."""
    return (_mix(np.arange(1, 5)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


#: For A, C, G and T.
SEEDS = _seeds()


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    by %= 32
    return x << np.uint32(by) | x >> np.uint32(32 - by) if by else x


def _rolling(code: np.ndarray, s: int) -> np.ndarray:
    """The lesser of both strands' hashes of each s-mer: seeds of its bases, turned by their places, xor-ed; so the next
    s-mer's is this one's turned, without the base that leaves and with the one that enters."""
    n = len(code) - s + 1
    base = code & np.uint8(3)
    own, other = SEEDS[base], SEEDS[3 - base]
    ahead, back = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for j in range(s):
        ahead ^= _turned(own[j : j + n], s - 1 - j)
        back ^= _turned(other[j : j + n], j)
    return np.minimum(ahead, back)


def _ranks(code: np.ndarray, s: int, order: str) -> np.ndarray:
    """Of the s-mer at each place; those with ambiguous bases have any."""
    if order == "rolling":
        return _rolling(code, s)
    n = len(code) - s + 1
    kind = np.uint32 if s <= 16 else np.uint64
    x = np.zeros(n, kind)
    for i in range(s):
        x = x << kind(2) | (code[i : i + n] & np.uint8(3))
    if s <= TABLE_S:
        return order_table(order, s)[x]
    least = np.minimum(x, _reversed_code(x, s))
    if order == "md5":
        raise ValueError(f"the md5 order is for s up to {TABLE_S}; use 'mix' or 'lex'")
    return least if order == "lex" else _mix(least)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    size, n = 1, len(x) - w + 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def select(code: np.ndarray, at: np.ndarray, k: int, s: int, order: str) -> np.ndarray:
    """Starts of the selected k-mers in a block of sequences. code: 0 to 3, 4 for anything else; at: offsets."""
    w, n = k - s + 1, len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = _ranks(code, s, order)
    mid = (w - 1) // 2
    chosen = h[mid : mid + n] == _least(h, w)
    bad = np.concatenate([[0], np.cumsum(code > 3, dtype=np.int64)])
    chosen &= bad[k : k + n] == bad[:n]
    found = np.flatnonzero(chosen)
    return found[found + k <= at[np.searchsorted(at, found, "right")]]


def packed(code: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Canonical k-mers as numbers, k up to 31."""
    x, y = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for i in range(k):
        x = x << 2 | code[starts + i]
        y = y << 2 | (3 - code[starts + (k - 1 - i)])
    return np.minimum(x, y)


def packed_wide(code: np.ndarray, starts: np.ndarray, k: int) -> pa.Array:
    """Canonical k-mers as numbers of two 64-bit words, k up to 61, as decimals."""

    def words(at) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for i in range(k):
            high = high << np.uint64(2) | low >> np.uint64(62)
            low = low << np.uint64(2) | at(i)
        return high, low

    x, y = words(lambda i: code[starts + i].astype(np.uint64)), words(lambda i: (3 - code[starts + (k - 1 - i)]).astype(np.uint64))
    less = (x[0] < y[0]) | ((x[0] == y[0]) & (x[1] <= y[1]))
    out = np.stack([np.where(less, x[1], y[1]), np.where(less, x[0], y[0])], 1)
    return pa.Array.from_buffers(WIDE, len(out), [None, pa.py_buffer(np.ascontiguousarray(out))])


def spelled(code: np.ndarray, starts: np.ndarray, k: int) -> pa.Array:
    """Canonical k-mers as strings, any k."""
    x = code[starts[:, None] + np.arange(k)]
    y = 3 - x[:, ::-1]
    differ = x != y
    first = differ.argmax(1)
    each = np.arange(len(x))
    out = np.where((x[each, first] <= y[each, first])[:, None], x, y)
    return pa.array(np.ascontiguousarray(_LETTERS[out]).view(f"S{k}").reshape(-1).astype(f"U{k}") if len(out) else [], pa.string())


def blocks(seqs: pa.Array, k: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, codes, offsets, shift) of runs of whole sequences, a code for each character. Null is empty.

    A sequence of more than BLOCK_BASES comes in pieces that overlap by k - 1; shift is where a piece begins in it.
    """
    seqs = seqs.fill_null("").cast(pa.large_string())
    n = len(seqs)
    if not n:
        return
    _, at, data = seqs.buffers()
    at = np.frombuffer(at, np.int64)[seqs.offset : seqs.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK_BASES, "right")) - 1)
        part, cut = data[at[row] : at[end]], at[row : end + 1] - at[row]
        if not part.size or part.max() < 0x80:
            code = _CODE[part]
        else:  # further bytes of a character do not count
            more = (part & 0xC0) == 0x80
            cut = cut - np.concatenate([[0], np.cumsum(more)])[cut]
            code = _CODE[part[~more]]
        if end == row + 1 and len(code) > BLOCK_BASES:
            for a in range(0, max(len(code) - k + 1, 1), BLOCK_BASES):
                piece = code[a : a + BLOCK_BASES + k - 1]
                yield row, piece, np.array([0, len(piece)]), a
        else:
            yield row, code, cut, 0
        row = end
