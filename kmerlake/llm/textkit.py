"""Vectorised word kernels over Arrow string columns.

Texts are handled as UTF-8 bytes, in blocks of whole documents of about BLOCK_BYTES, so memory
follows the longest document and never the partition. Words are named by 64-bit hashes: two of n
different words share one with probability n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z; all other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes between words.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words of letters and digits, for folded texts: 00-2F, 3A-60, 7B-7F.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse for i < n, modulo 2 ** 64."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for b in (_BASE, _BASE_INVERSE):
        x = np.full(max(n, BLOCK_BYTES + 1), b, U64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=U64))
    if n <= BLOCK_BYTES + 1:  # those of a longer text are not kept
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 finaliser; x is uint64 and stays as it is."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about `size` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, of): the words of a block; document i has words of[i] to of[i + 1]."""
    n = len(data)
    low = FOLD[data]
    inside = ~between[low]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < n)]
    begin[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((low.astype(U64) + U64(1)) * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ (ends - starts).astype(U64) * U64(_BASE)), starts, ends, np.searchsorted(starts, at)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words; the order counts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    x = np.zeros(n, U64)
    for i in range(k):
        x = mix(x * U64(0xD6E8FEB86659FD93) + h[i : i + n])
    return x


def owners(of: np.ndarray) -> np.ndarray:
    """The document of each item, from of[i] to of[i + 1]."""
    return np.repeat(np.arange(len(of) - 1), np.diff(of))
