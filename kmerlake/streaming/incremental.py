"""Incremental forms of the pipelines over reads that keep arriving.

Targets and groups are static. Depth counts are associative, so a stream's state is one count for each
(sample, target k-mer) seen: bounded by the targets, however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.operators.syncmers import syncmers
from kmerlake.operators.targets import union_kmers
from kmerlake.operators import sides
from kmerlake.plans.params import MAX_DEPTH


def streaming_abundance(reads: DataFrame, tk: DataFrame, k: int, s: int, order: str | None = None) -> DataFrame:
    """sample, kmer, depth for `update` or `complete` mode. reads: a streaming sample, seq."""
    found = syncmers(reads.select("sample", "seq"), k, s, order=order)
    hits = found.join(sides.bounded(union_kmers(tk)), "kmer", "left_semi")
    return hits.groupBy("sample", "kmer").agg(F.least(F.count("*"), F.lit(MAX_DEPTH)).cast("long").alias("depth"))


def streaming_read_hits(reads: DataFrame, index: DataFrame, k: int, s: int, order: str | None = None) -> DataFrame:
    """Per read and group: sample, seq_id, group_idx and kmer of each hit, in `append` mode; no state."""
    found = syncmers(reads.select("sample", "seq_id", "seq"), k, s, order=order)
    return found.join(sides.bounded(index), "kmer").select("sample", "seq_id", "group_idx", "kmer")


def windowed_sample_stats(reads: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Reads and bases of each sample and time window; rows later than `late` are left out. reads: sample, seq and a time."""
    seqs, bases = F.count("*").alias("sample_seqs"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("sample_bases")
    return reads.withWatermark(time, late).groupBy(F.window(time, width), "sample").agg(seqs, bases)


def merged_depths(before: DataFrame, more: DataFrame) -> DataFrame:
    """Counts of two batches as one: saturation commutes with sums."""
    total: Column = F.least(F.sum("depth"), F.lit(MAX_DEPTH)).cast("long").alias("depth")
    return before.unionByName(more).groupBy("sample", "kmer").agg(total)
