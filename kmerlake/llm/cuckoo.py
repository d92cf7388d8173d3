"""A cuckoo filter: 16-bit fingerprints, four to a bucket, with deletion. One holds one bounded shard."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
U64 = np.uint64


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        """table: buckets (a power of two) by SLOTS; 0 is an empty slot."""
        self.table = table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """keys: distinct uint64 hashes."""
        buckets = 1 << max(4, int(len(keys) / (SLOTS * 0.85)).bit_length())
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if all(made.insert(k) for k in keys):
                return made
            buckets *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.asarray(keys, U64)
        mask = U64(len(self.table) - 1)
        print_ = (keys >> U64(48)) % U64(0xFFFF) + U64(1)
        first = keys & mask
        return print_.astype(np.uint16), first.astype(np.int64), (first ^ self._jump(print_) & mask).astype(np.int64)

    @staticmethod
    def _jump(print_: np.ndarray) -> np.ndarray:
        return print_ * U64(0x5BD1E995)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self._places(keys)
        return (self.table[a] == f[:, None]).any(1) | (self.table[b] == f[:, None]).any(1)

    def insert(self, key) -> bool:
        """False if no place was found; the filter must then be built anew with more buckets."""
        f, a, b = (int(x[0]) for x in self._places(np.array([key], U64)))
        t = self.table
        for at in (a, b):
            free = np.flatnonzero(t[at] == 0)
            if len(free):
                t[at, free[0]] = f
                return True
        at = b
        for kick in range(KICKS):
            slot = (f + kick) % SLOTS
            f, t[at, slot] = int(t[at, slot]), f
            at = (at ^ (f * 0x5BD1E995)) & (len(t) - 1)
            free = np.flatnonzero(t[at] == 0)
            if len(free):
                t[at, free[0]] = f
                return True
        return False

    def delete(self, key) -> bool:
        """Only for keys that were inserted."""
        f, a, b = (int(x[0]) for x in self._places(np.array([key], U64)))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == f)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False
