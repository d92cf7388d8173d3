"""Target sets: merging records, sketching, masking, discriminatory filtering.

The order of the filters changes results and is fixed: sketch, merge, mask, discriminate.
`tk` is target_idx, target, pos, kmer: a row for each occurrence. `info` is target_idx, target, length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.functions import dna
from kmerlake.operators import prefilter, prefix, sides
from kmerlake.operators.syncmers import syncmers
from kmerlake.sources import shared


@dataclass
class Targets:
    info: DataFrame
    kmers: DataFrame


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def merge_records(records: DataFrame, size: Column | None = None) -> DataFrame:
    """records: target, file_idx, rec_idx, seq. Adds offset: the length of the target's records before. size: of a record, by default its sequence's."""
    size = F.length("seq") if size is None else size
    dealt = prefix.with_block_sums(records, "target", ["file_idx", "rec_idx"], size)
    inside = Window.partitionBy("target", "file_idx", prefix.BLOCK).orderBy("rec_idx").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col(prefix.BEFORE) + F.coalesce(F.sum(size).over(inside), F.lit(0))
    return dealt.withColumn("offset", offset.cast("long")).drop(prefix.BLOCK, prefix.BEFORE, prefix.TOTAL)


def build(records: DataFrame, k: int, s: int, fraction: float = 1.0, order: str | None = None, notes: dict | None = None) -> Targets:
    """records: target_idx, target, seq and perhaps file_idx, rec_idx of targets with several records.

    The records are read once: k-mers and lengths come from one pass and are written, then offsets are added.
    notes: gets target_records, target_bases and target_kmers_selected of that pass.
    """
    place = ["file_idx", "rec_idx"] if {"file_idx", "rec_idx"} <= set(records.columns) else []
    found = syncmers(records.select("target_idx", "target", *place, "seq"), k, s, positions=True, order=order, tally=True)
    found = shared.keep(found, "targets", notes, target_records=_sum("seqs"), target_bases=_sum("bases"), target_kmers_selected=F.count("kmer"))
    sizes, kmers = found.filter("kmer IS NULL"), found.filter("kmer IS NOT NULL")
    info = sizes.groupBy("target_idx", "target").agg(F.sum("bases").alias("length"))
    if place:
        offsets = merge_records(sizes.select("target", *place, "bases"), F.col("bases")).select("target", *place, "offset")
        kmers = kmers.join(sides.bounded(offsets), ["target", *place]).withColumn("pos", F.col("offset") + F.col("pos"))
    kmers = kmers.select("target_idx", "target", "pos", "kmer")
    if fraction < 1:
        kmers = kmers.filter(sketched(F.col("kmer"), k, fraction))
    return Targets(info, kmers)


def sketched(kmer: Column, k: int, fraction: float) -> Column:
    return dna.sketched(dna.decode(kmer, k), fraction)


def distinct_kmers(tk: DataFrame) -> DataFrame:
    return tk.select("target_idx", "kmer").distinct()


def union_kmers(tk: DataFrame) -> DataFrame:
    return tk.select("kmer").distinct()


def background_hits(union: DataFrame, background: DataFrame) -> DataFrame:
    """Target k-mers that the background has; probing the targets first keeps this within their size. background: kmer."""
    return background.select("kmer").join(sides.bounded(union), "kmer", "left_semi").distinct()


def background_hits_of(tk: DataFrame, reads: DataFrame, k: int, s: int, order: str | None = None) -> DataFrame:
    """The same of tk, from sequences (seq); if the targets are too large to broadcast, a filter in the generator drops most others."""
    side, rows = sides.sized(union_kmers(tk), tk)
    only = None if rows <= sides.BROADCAST_ROWS else prefilter.build(side, rows)
    found = syncmers(reads.select("seq"), k, s, order=order, only=only)
    if only is not None:
        found = found.distinct()
    return found.join(sides.bounded(side, rows), "kmer", "left_semi").distinct()


def shared_kmers_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """kmer, once each: those that both target sets have."""
    return union_kmers(a).join(union_kmers(b), "kmer", "left_semi")


def mask(tk: DataFrame, hits: DataFrame) -> DataFrame:
    return tk.join(hits, "kmer", "left_anti").select(*tk.columns)


def discriminatory(tk: DataFrame, n_targets: int) -> DataFrame:
    """K-mers of exactly one target; with one target all of them."""
    if n_targets <= 1:
        return tk
    own = tk.groupBy("kmer").agg(F.min("target_idx").alias("_lo"), F.max("target_idx").alias("_hi")).filter("_lo = _hi").select("kmer")
    return tk.join(own, "kmer", "left_semi").select(*tk.columns)


def shared_counts(tk: DataFrame) -> DataFrame:
    """distinct_kmers, shared_kmers (of more than one target), unique_kmers and target_kmers (summed over targets)."""
    per = distinct_kmers(tk).groupBy("kmer").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("distinct_kmers"), F.count_if(F.col("n") > 1).alias("shared_kmers"), F.count_if(F.col("n") == 1).alias("unique_kmers"), F.coalesce(F.sum("n"), F.lit(0)).alias("target_kmers"))


def summary(records: DataFrame, tk: DataFrame) -> DataFrame:
    """One row: targets, records, bases, then shared_counts and shared_pct, the share of distinct k-mers that several targets have. records: target_idx, seq."""
    size = records.agg(F.count_distinct("target_idx").alias("targets"), F.count("*").alias("records"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("bases"))
    pct = F.when(F.col("distinct_kmers") > 0, 100 * F.col("shared_kmers") / F.col("distinct_kmers")).otherwise(F.lit(0.0))
    return size.crossJoin(shared_counts(tk)).withColumn("shared_pct", pct)  # one row each


def dump(tk: DataFrame, k: int) -> DataFrame:
    """target, position, kmer (as bases)."""
    return tk.select("target", F.col("pos").alias("position"), dna.decode("kmer", k).alias("kmer"))
