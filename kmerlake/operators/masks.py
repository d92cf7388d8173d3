"""A k-mer's groups as 128 bits in two longs, lo and hi: one row a k-mer, whatever the number of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.plans.params import MAX_GROUPS

WORD = 64


def _bit(g: Column, word: int) -> Column:
    at = g.cast("int") - WORD * word
    return F.when((at >= 0) & (at < WORD), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))


def from_rows(index: DataFrame) -> DataFrame:
    """kmer, group_idx rows to kmer, lo, hi. Bits are combined in each task before the k-mers meet."""
    return index.groupBy("kmer").agg(F.bit_or(_bit(F.col("group_idx"), 0)).alias("lo"), F.bit_or(_bit(F.col("group_idx"), 1)).alias("hi"))


def is_mask(index: DataFrame) -> bool:
    return {"lo", "hi"} <= set(index.columns)


def has(lo: Column, hi: Column, g: Column) -> Column:
    """Whether group g is among them."""
    word = F.when(g < WORD, F.call_function("shiftright", lo, g)).otherwise(F.call_function("shiftright", hi, g - WORD))
    return word.bitwiseAND(F.lit(1).cast("long")) == 1


def n_groups(lo: Column | str = "lo", hi: Column | str = "hi") -> Column:
    return F.bit_count(lo) + F.bit_count(hi)


def groups_of(lo: Column | str = "lo", hi: Column | str = "hi") -> Column:
    """The numbers of the groups, ascending."""
    lo, hi = (F.col(c) if isinstance(c, str) else c for c in (lo, hi))
    return F.filter(F.sequence(F.lit(0), F.lit(MAX_GROUPS - 1)), lambda g: has(lo, hi, g))


def to_rows(masks: DataFrame) -> DataFrame:
    return masks.select("kmer", F.explode(groups_of()).alias("group_idx"))


def unique(masks: DataFrame) -> DataFrame:
    """K-mers of exactly one group."""
    return masks.filter(n_groups() == 1)
