"""Classification of reads by the groups whose k-mers they hit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.operators import masks, prefilter, sides
from kmerlake.operators.containment import in_order
from kmerlake.operators.syncmers import syncmers
from kmerlake.sources import shared

AMBIGUOUS, UNCLASSIFIED = "ambiguous", "unclassified"
CLASSIFIED = "classified"


def group_index(groups: DataFrame, k: int, s: int, order: str | None = None) -> DataFrame:
    """groups: group_idx, seq. Gives kmer, group_idx once each."""
    return syncmers(groups.select("group_idx", "seq"), k, s, order=order).select("kmer", "group_idx").distinct()


def mask_index(groups: DataFrame, k: int, s: int, order: str | None = None) -> DataFrame:
    """groups: group_idx, seq. Gives kmer, lo, hi (operators.masks), a row for each k-mer."""
    return masks.from_rows(syncmers(groups.select("group_idx", "seq"), k, s, order=order))


def discriminatory(index: DataFrame) -> DataFrame:
    """K-mers of exactly one group, of an index of rows or of masks."""
    if masks.is_mask(index):
        return masks.unique(index)
    return index.groupBy("kmer").agg(F.min("group_idx").alias("group_idx"), F.max("group_idx").alias("_hi")).filter("group_idx = _hi").select("kmer", "group_idx")


def group_counts(index: DataFrame) -> DataFrame:
    """group_idx, kmers, unique_kmers."""
    per = index.withColumn("_n", F.count("*").over(Window.partitionBy("kmer")))
    return per.groupBy("group_idx").agg(F.count("*").alias("kmers"), F.count_if(F.col("_n") == 1).alias("unique_kmers"))


def per_sequence(reads: DataFrame, index: DataFrame, groups: DataFrame, k: int, s: int, abs_threshold: int = 1, rel_threshold: float = 0.0, order: str | None = None, n_kmers: int | None = None) -> DataFrame:
    """Per read: sample, seq_id, classification, group, hits, seq_kmers, seq_length.

    A group matches with at least abs_threshold hits that are at least rel_threshold of the read's k-mers;
    one match classifies, several are ambiguous (listed in the groups' order), none is unclassified ('.', '0').
    index: rows or masks; n_kmers: its k-mers, where known. groups: group_idx, group. Reads without k-mers are unclassified. reads: sample, seq_id (unique in a sample), seq.
    """
    # a k-mer's groups as one mask, so a read's k-mers stay what they are and count once
    own = index if masks.is_mask(index) else masks.from_rows(index)
    side, n_kmers = sides.counted(own) if n_kmers is None else (own, n_kmers)
    small = n_kmers <= sides.BROADCAST_ROWS
    only = None if small else prefilter.build(side, n_kmers)
    # one pass for hits and for each read's number of k-mers and length
    found = syncmers(reads.select("sample", "seq_id", "seq"), k, s, order=order, tally=True, only=only)
    if small:
        met = found.join(F.broadcast(side), "kmer", "left").filter("kmer IS NULL OR lo IS NOT NULL")
    else:
        found = shared.keep(found, "hits")
        none = [F.lit(None).cast("long").alias(c) for c in ("lo", "hi")]
        met = found.filter("kmer IS NOT NULL").join(side.hint("shuffle_hash"), "kmer").unionByName(found.filter("kmer IS NULL").select("*", *none))
    # a row for each set of groups that k-mers of the read have, and one for the read
    sets = met.groupBy("sample", "seq_id", "lo", "hi").agg(F.count("*").alias("n"), F.sum("mers").alias("mers"), F.sum("bases").alias("bases"))
    per = sets.groupBy("sample", "seq_id").agg(F.sum("mers").alias("seq_kmers"), F.sum("bases").alias("seq_length"), F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi", "n"))).alias("_sets"))
    names = groups.select(F.col("group_idx").cast("int").alias("g"), F.col("group").alias("name"))
    every = names.agg(F.sort_array(F.collect_list(F.struct("g", "name"))).alias("_every"))  # at most MAX_GROUPS
    hits_of = lambda g: F.aggregate(F.filter("_sets", lambda x: masks.has(x["lo"], x["hi"], g)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    all_hits = F.transform("_every", lambda x: F.struct(x["g"].alias("group_idx"), x["name"].alias("group"), hits_of(x["g"]).alias("hits")))
    matches = lambda x: (x["hits"] >= abs_threshold) & (F.try_divide(x["hits"], F.col("seq_kmers")) >= rel_threshold)
    out = per.crossJoin(F.broadcast(every)).withColumn("_all", all_hits).withColumn("m", F.filter("_all", lambda x: F.coalesce(matches(x), F.lit(False))))
    n = F.size("m")
    return out.select(
        "sample", "seq_id",
        F.when(n == 1, CLASSIFIED).when(n > 1, AMBIGUOUS).otherwise(UNCLASSIFIED).alias("classification"),
        F.when(n > 0, F.array_join(F.transform("m", lambda x: x["group"]), ",")).otherwise(".").alias("group"),
        F.when(n > 0, F.array_join(F.transform("m", lambda x: x["hits"].cast("string")), ",")).otherwise("0").alias("hits"),
        "seq_kmers", "seq_length",
    )


def buckets(per_seq: DataFrame) -> DataFrame:
    """sample, seq_id, bucket (group, ambiguous or unclassified), seq_length."""
    bucket = F.when(F.col("classification") == CLASSIFIED, F.col("group")).otherwise(F.col("classification"))
    return per_seq.select("sample", "seq_id", bucket.alias("bucket"), "seq_length")


def summary(bucketed: DataFrame, groups: DataFrame) -> DataFrame:
    """sample, group, seqs_pct, seqs, bases_pct, bases, bucket_idx: every group and both other buckets for each sample."""
    spark = bucketed.sparkSession
    last = F.lit(1 << 30)
    pseudo = spark.createDataFrame([(AMBIGUOUS, 0), (UNCLASSIFIED, 1)], "bucket string, _i int").select("bucket", (last + F.col("_i")).alias("bucket_idx"))
    names = groups.select(F.col("group").alias("bucket"), F.col("group_idx").cast("int").alias("bucket_idx")).unionByName(pseudo)
    # counted once; what a sample has no reads of is added from the names
    every = names.agg(F.collect_list(F.struct("bucket", "bucket_idx")).alias("_every"))  # at most MAX_GROUPS and two
    counts = bucketed.groupBy("sample", "bucket").agg(F.count("*").alias("seqs"), F.sum("seq_length").alias("bases"))
    got = counts.groupBy("sample").agg(F.collect_list(F.struct("bucket", "seqs", "bases")).alias("_got")).crossJoin(F.broadcast(every))
    own = lambda x: F.get(F.filter("_got", lambda y: y["bucket"] == x["bucket"]), 0)
    rows = got.select("sample", F.explode(F.transform("_every", lambda x: F.struct(x["bucket"].alias("bucket"), x["bucket_idx"].alias("bucket_idx"), own(x).alias("own")))).alias("x"))
    grid = rows.select("sample", "x.bucket", "x.bucket_idx", *(F.coalesce(F.col(f"x.own.{c}"), F.lit(0)).cast("long").alias(c) for c in ("seqs", "bases")))
    w = Window.partitionBy("sample")
    pct = lambda c: F.when(F.sum(c).over(w) > 0, 100 * F.col(c) / F.sum(c).over(w)).otherwise(F.lit(0.0))
    return grid.select("sample", F.col("bucket").alias("group"), pct("seqs").alias("seqs_pct"), "seqs", pct("bases").alias("bases_pct"), "bases", "bucket_idx")


def summary_order(samples: Sequence[str] | None = None) -> list:
    return [in_order("sample", samples), F.desc("seqs_pct"), F.asc("bucket_idx")]
