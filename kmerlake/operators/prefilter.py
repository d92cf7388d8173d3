"""A blocked Bloom filter over the k-mers of a join side that is too large to broadcast.

It is applied inside the generator, so only k-mers that may be on that side leave the task; the exact join follows. A key
sets one bit in each of the eight words of one block. BITS bits a key let about one in two hundred others pass;
the filter never grows over MOST_BYTES, beyond which more pass, and none that is there is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BITS = 12
MOST_BYTES = 64 << 20
SEGMENT_BLOCKS = 1 << 15  # 1 MB to a task that builds
WORDS = 8
U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The published splitmix64 finaliser."""
    x = x.astype(U64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U64(shift))) * U64(factor)
    return x ^ (x >> U64(31))


#: An odd factor for each word of a block.
_FACTORS = (_mixed(np.arange(1, WORDS + 1)) | U64(1)) & U64(0xFFFFFFFF)


def keys(kmers: pa.Array) -> np.ndarray:
    """A 64-bit key for each k-mer, packed as a number or as a decimal of 128 bits."""
    if pa.types.is_decimal(kmers.type):
        words = np.frombuffer(kmers.buffers()[1], U64).reshape(-1, 2)[kmers.offset : kmers.offset + len(kmers)]
        return _mixed(words[:, 0] ^ _mixed(words[:, 1] + U64(1)))
    return _mixed(kmers.to_numpy(zero_copy_only=False).view(U64))


def _bits(key: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, mask for each of its words) of keys."""
    block = ((key >> U64(32)) * U64(blocks)) >> U64(32)
    low = key & U64(0xFFFFFFFF)
    shift = ((low[:, None] * _FACTORS) & U64(0xFFFFFFFF)) >> U64(27)
    return block.astype(np.int64), (U64(1) << shift).astype(np.uint32)


def may_be_in(table: np.ndarray, kmers: pa.Array) -> np.ndarray:
    """For each k-mer, whether it may be one of those that the table was built from."""
    out = np.empty(len(kmers), bool)
    key = keys(kmers)
    for a in range(0, len(key), 1 << 16):
        block, mask = _bits(key[a : a + (1 << 16)], len(table))
        out[a : a + (1 << 16)] = ((table[block] & mask) == mask).all(1)
    return out


def build(kmers: DataFrame, rows: int):
    """The filter over kmers (kmer, each once, `rows` of them) as a broadcast table of blocks.

    Each task sets the bits of some segments of it; only the finished segments, MOST_BYTES in all at most, reach the driver.
    """
    spark: SparkSession = kmers.sparkSession
    blocks = max(1, min(rows * BITS // (32 * WORDS) + 1, MOST_BYTES // (4 * WORDS)))
    segments = -(-blocks // SEGMENT_BLOCKS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = keys(b.column(0))
            block, _ = _bits(key, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block // SEGMENT_BLOCKS), pa.array(key.view(np.int64))], ["segment", "key"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            segment, key = b.column(0).to_numpy(), b.column(1).to_numpy().view(U64)
            for s in np.unique(segment).tolist():
                part = parts.setdefault(s, np.zeros((min(SEGMENT_BLOCKS, blocks - s * SEGMENT_BLOCKS), WORDS), np.uint32))
                block, mask = _bits(key[segment == s], blocks)
                np.bitwise_or.at(part, block - s * SEGMENT_BLOCKS, mask)
        for s, part in parts.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int64()), "bits": pa.array([part.tobytes()])})

    parts = kmers.select("kmer").mapInArrow(dealt, "segment long, key long").repartition(segments, "segment").mapInArrow(built, "segment long, bits binary")
    table = np.zeros((blocks, WORDS), np.uint32)
    for r in parts.collect():
        part = np.frombuffer(r["bits"], np.uint32).reshape(-1, WORDS)
        table[r["segment"] * SEGMENT_BLOCKS :][: len(part)] = part
    return spark.sparkContext.broadcast(table)
