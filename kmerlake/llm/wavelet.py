"""Wavelet matrix over one shard of token ids, in one succinct file.

A shard file is: magic, ten unsigned 64-bit numbers (part, place, tokens, documents, planes, 0, sizes of
the next three blocks, 0), then the zstd blocks of the document ids, of the documents' lengths and of the
zeros counts of the planes, zeros up to a multiple of eight, then for each plane its bits in blocks of BLOCK
(a last one is never full) and the ones before each block as unsigned 32-bit numbers. Ids take as many bits
as the largest, and rank samples a sixteenth more; the file is used as it lies, without unpacking: access
and counting touch one block a plane, occurrence lookup one block for each occurrence and plane.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

MAGIC = b"KMLWMX02"
BLOCK = 512
_HEAD = struct.Struct("<10Q")
U64 = np.uint64


def _pack(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(block: bytes) -> bytes:
    return pa.decompress(block[8:], decompressed_size=struct.unpack_from("<Q", block)[0], codec="zstd", asbytes=True)


class Shard:
    """Planes from the highest bit down; plane p + 1 holds plane p's sequence with its zeros before its ones.

    A plane is a row of eight 64-bit words for each block; samples are the ones before each block.
    """

    def __init__(self, planes: list[np.ndarray], samples: list[np.ndarray], zeros: list[int], n: int, doc_ids: np.ndarray, lengths: np.ndarray, part: int = 0, place: int = 0):
        self.planes, self.samples, self.zeros, self.n, self.doc_ids, self.lengths, self.part, self.place = planes, samples, zeros, n, doc_ids, lengths, part, place

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, part: int = 0, place: int = 0) -> Shard:
        planes, samples, zeros = [], [], []
        top = int(np.max(ids, initial=0))
        x = np.array(ids, np.uint16 if top < 1 << 16 else np.uint32)
        y = np.empty_like(x)
        for p in reversed(range(top.bit_length())):
            bits = (x >> x.dtype.type(p)).astype(np.uint8) & np.uint8(1)
            words = np.zeros((len(x) // BLOCK + 1, BLOCK // 64), U64)
            packed = np.packbits(bits, bitorder="little")
            words.reshape(-1).view(np.uint8)[: len(packed)] = packed
            planes.append(words)
            samples.append(np.cumsum(np.bitwise_count(words).sum(1, dtype=np.uint32), dtype=np.uint32) - np.bitwise_count(words).sum(1, dtype=np.uint32))
            ones = bits.view(bool)
            low = np.compress(~ones, x)
            zeros.append(len(low))
            y[: len(low)] = low
            np.compress(ones, x, out=y[len(low) :])
            x, y = y, x
        return cls(planes, samples, zeros, len(x), np.asarray(doc_ids, np.int64), np.asarray(lengths, U64), part, place)

    def to_bytes(self) -> bytes:
        blocks = [_pack(self.doc_ids.tobytes()), _pack(self.lengths.tobytes()), _pack(np.array(self.zeros, U64).tobytes())]
        head = _HEAD.pack(self.part, self.place, self.n, len(self.doc_ids), len(self.planes), 0, *map(len, blocks), 0)
        fill = bytes(-(len(MAGIC) + len(head) + sum(map(len, blocks))) % 8)
        return b"".join([MAGIC, head, *blocks, fill, *(x.tobytes() for pair in zip(self.planes, self.samples, strict=True) for x in pair)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        part, place, n, docs, n_planes, _, *sizes, _ = _HEAD.unpack_from(data, 8)
        at, blocks = 8 + _HEAD.size, []
        for size in sizes:
            blocks.append(_unpack(data[at : at + size]))
            at += size
        at += -at % 8
        rows = n // BLOCK + 1
        if at + n_planes * rows * (BLOCK // 8 + 4) != len(data):
            raise ValueError("token shard is cut short or has bytes left over")
        planes, samples = [], []
        for _ in range(n_planes):
            planes.append(np.frombuffer(data, "<u8", rows * (BLOCK // 64), at).reshape(rows, -1))
            samples.append(np.frombuffer(data, "<u4", rows, at + rows * (BLOCK // 8)))
            at += rows * (BLOCK // 8 + 4)
        ids, lengths, zeros = (np.frombuffer(b, t) for b, t in zip(blocks, (np.int64, U64, U64), strict=True))
        if len(ids) != docs or int(lengths.sum()) != n:
            raise ValueError("token shard's counts disagree")
        return cls(planes, samples, zeros.astype(int).tolist(), n, ids, lengths, part, place)

    def decode(self) -> np.ndarray:
        """All ids in order: the stable partitions are undone from the last plane up."""
        x = np.zeros(self.n, np.uint32)
        for p, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(x)
            up[~bits], up[bits] = x[:zeros], x[zeros:] | np.uint32(1 << p)
            x = up
        return x

    def _ones(self, p: int, i) -> np.ndarray:
        """Ones before place i in plane p: the block's sample and the words of the block before it."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        words = self.planes[p][i // BLOCK]
        # bits of each word that stand before i
        before = np.clip((i % BLOCK)[:, None] - 64 * np.arange(BLOCK // 64), 0, 64).astype(U64)
        below = np.where(before == 64, ~U64(0), (U64(1) << (before & U64(63))) - U64(1))
        return self.samples[p][i // BLOCK].astype(np.int64) + np.bitwise_count(words & below).sum(1, dtype=np.int64)

    def _select(self, p: int, bit: int, j: np.ndarray) -> np.ndarray:
        """Place of the one or zero number j (from 0) of plane p, from its block alone."""
        ones = self.samples[p].astype(np.int64)
        first = ones if bit else BLOCK * np.arange(len(ones)) - ones
        out = np.empty(len(j), np.int64)
        for a in range(0, len(j), 4096):
            some = j[a : a + 4096]
            block = np.searchsorted(first, some, "right") - 1
            bits = np.unpackbits(np.ascontiguousarray(self.planes[p][block]).view(np.uint8), axis=1, bitorder="little") == bit
            out[a : a + 4096] = BLOCK * block + (np.cumsum(bits, axis=1, dtype=np.int16) > (some - first[block])[:, None]).argmax(1)
        return out

    def access(self, i) -> np.ndarray:
        """Ids at the places i."""
        i, x = np.atleast_1d(np.asarray(i, np.int64)), 0
        for p in range(len(self.planes)):
            ones = self._ones(p, i)
            bit = self._ones(p, i + 1) - ones
            x = x * 2 + bit
            i = np.where(bit == 1, self.zeros[p] + ones, i - ones)
        return np.asarray(x + np.zeros(len(i), np.int64))

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of token before place `end` lie below the last plane."""
        a, b = 0, end
        for p in range(len(self.planes)):
            oa, ob = self._ones(p, [a, b]).tolist()
            a, b = (self.zeros[p] + oa, self.zeros[p] + ob) if token >> (len(self.planes) - 1 - p) & 1 else (a - oa, b - ob)
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of token before place `end`."""
        if token >> len(self.planes):
            return 0
        a, b = self._range(token, self.n if end is None else end)
        return b - a

    def locate(self, token: int) -> np.ndarray:
        """Places of all occurrences, in their order: select, from the last plane up."""
        if token >> len(self.planes):
            return np.empty(0, np.int64)
        a, b = self._range(token, self.n)
        at = np.arange(a, b)
        for p in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - p) & 1
            at = self._select(p, bit, at - (self.zeros[p] if bit else 0))
        return at
