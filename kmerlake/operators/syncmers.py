"""Canonical open syncmers of a sequence column: a vectorised generator and the same in DataFrame functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlake.functions import dna
from kmerlake.operators import kernel, prefilter
from kmerlake.plans.params import check_k_s


TALLY = ("seqs", "bases", "mers")


def kmer_type(k: int, text: bool = False) -> T.DataType:
    return T.StringType() if text else T.LongType() if k <= 31 else T.DecimalType(38, 0)


def syncmers(df: DataFrame, k: int = 31, s: int = 9, seq: str = "seq", positions: bool = False, order: str | None = None, text: bool = False, tally: bool = False, only=None) -> DataFrame:
    """A row for each selected k-mer of each row: df's other columns, pos (if asked for) and kmer.

    kmer is a number, a decimal of two 64-bit words for k over 31, or a string if `text` is set. order: how s-mers rank,
    "md5" (default for s up to 9), "mix" (default beyond), "rolling" or "lex". Sequences of any length go through in pieces.
    only: a prefilter; k-mers that it does not know are left out. tally: adds, for each batch and each of df's other
    columns' values in it, a row without k-mer that has seqs, bases and mers, the k-mers selected (also those that
    `only` leaves out), so one pass gives both.
    """
    check_k_s(k, s)
    order = order or ("md5" if s <= kernel.TABLE_S else "mix")
    keys = [c for c in df.columns if c != seq]
    fields = [df.schema[c] for c in keys] + [T.StructField("pos", T.LongType())] * positions + [T.StructField("kmer", kmer_type(k, text))]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in TALLY if tally])

    def spell(code: np.ndarray, starts: np.ndarray) -> pa.Array:
        if text:
            return kernel.spelled(code, starts, k)
        return pa.array(kernel.packed(code, starts, k)) if k <= 31 else kernel.packed_wide(code, starts, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mers = np.zeros(b.num_rows, np.int64)
            for row, code, at, shift in kernel.blocks(b.column(len(keys)), k):
                starts = kernel.select(code, at, k, s, order)
                own = np.searchsorted(at, starts, "right") - 1
                if tally:
                    mers[row : row + len(at) - 1] += np.bincount(own, minlength=len(at) - 1)
                kmers = spell(code, starts)
                if only is not None:
                    kept = np.flatnonzero(prefilter.may_be_in(only.value, kmers))
                    starts, own, kmers = starts[kept], own[kept], kmers.take(pa.array(kept))
                out = [b.column(i).take(pa.array(row + own)) for i in range(len(keys))]
                out += [pa.array(starts - at[own] + shift, pa.int64())] * positions
                yield pa.RecordBatch.from_arrays([*out, kmers, *(pa.nulls(len(kmers), pa.int64()) for _ in TALLY if tally)], schema.names)
            if tally and b.num_rows:
                yield _tallied(b, len(keys), mers, schema.names, positions, kind)

    kind = pa.string() if text else pa.int64() if k <= 31 else kernel.WIDE
    return df.select(*keys, seq).mapInArrow(run, schema)


def _tallied(b: pa.RecordBatch, n_keys: int, mers: np.ndarray, names: list[str], positions: bool, kind: pa.DataType) -> pa.RecordBatch:
    """seqs, bases and mers of a batch by its first columns, without k-mers."""
    bases = pc.utf8_length(b.column(n_keys)).cast(pa.int64()).fill_null(0)
    places = [f"_{i}" for i in range(n_keys)]
    rows = pa.table([*b.columns[:n_keys], bases, pa.array(mers)], names=[*places, "bases", "mers"])
    sums = rows.group_by(places).aggregate([("bases", "count"), ("bases", "sum"), ("mers", "sum")]).combine_chunks()
    n = len(sums)
    column = lambda c: sums[c].combine_chunks() if n else pa.nulls(0)
    return pa.RecordBatch.from_arrays([*(column(c) for c in places), *([pa.nulls(n, pa.int64())] * positions), pa.nulls(n, kind), *(column(c) for c in ("bases_count", "bases_sum", "mers_sum"))], names)


def split_long(df: DataFrame, k: int, chunk: int = 1 << 22, seq: str = "seq", offset: str = "chunk_start") -> DataFrame:
    """Sequences in pieces of at most chunk + k - 1 characters that overlap by k - 1, so no k-mer is lost and no task holds a chromosome."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - F.lit(k), F.lit(0)), F.lit(chunk))
    piece = F.substring(seq, F.col(offset) + 1, F.lit(chunk + k - 1))
    return df.withColumn(offset, F.explode(starts)).withColumn(seq, piece).withColumn(offset, F.col(offset).cast("long"))


def _smer_rank(m: Column, s: int, order: str) -> Column:
    if order == "md5":
        return dna.hash60(dna.canonical(m))
    return dna.rolling32(m, s, kernel.SEEDS.tolist())


def syncmers_native(df: DataFrame, k: int = 31, s: int = 9, seq: str = "seq", key: str = "id", order: str = "md5") -> DataFrame:
    """The same selection in DataFrame functions, a row for each s-mer: the definition that the generator is tested against. key must be unique. order: "md5" or "rolling"."""
    check_k_s(k, s)
    half = (k - s) // 2
    long_enough = df.select(key, seq).filter(F.length(seq) >= k)
    smers = long_enough.select(key, seq, F.explode(F.sequence(F.lit(1), F.length(seq) - s + 1)).alias("i"))
    m = F.substring(seq, F.col("i"), F.lit(s))
    hashed = smers.select(key, seq, "i", F.when(dna.is_unambiguous(m), _smer_rank(m, s, order)).alias("h"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(-half, half)
    chosen = hashed.withColumn("_lo", F.min("h").over(w)).withColumn("_n", F.count("h").over(w)).filter((F.col("_n") == k - s + 1) & (F.col("h") == F.col("_lo")))
    pos = F.col("i") - (half + 1)
    return chosen.select(key, pos.cast("long").alias("pos"), dna.canonical(F.substring(seq, pos + 1, F.lit(k))).alias("kmer"))
