"""Read-length histograms, and the reshaping that plots of reports need."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.operators import sides
from kmerlake.operators.classify import AMBIGUOUS, UNCLASSIFIED
from kmerlake.operators.containment import in_order

ALL = "all"


def all_in_one(reads: DataFrame) -> DataFrame:
    """Every read in one bucket, without looking for k-mers."""
    return reads.select("sample", F.lit(ALL).alias("bucket"), F.coalesce(F.length("seq"), F.lit(0)).cast("long").alias("seq_length"))


def histogram(bucketed: DataFrame) -> DataFrame:
    """sample, group, length, count and the totals of the sample and of the bucket on each row. bucketed: sample, bucket, seq_length."""
    counts = bucketed.groupBy("sample", F.col("bucket").alias("group"), F.col("seq_length").alias("length")).agg(F.count("*").alias("count"))
    bases = F.col("length") * F.col("count")
    by_sample, by_group = Window.partitionBy("sample"), Window.partitionBy("sample", "group")
    return counts.select(
        "sample", "group", "length", "count",
        F.sum("count").over(by_sample).alias("total_seqs_processed"), F.sum(bases).over(by_sample).alias("total_bp_processed"),
        F.sum("count").over(by_group).alias("group_seqs"), F.sum(bases).over(by_group).alias("group_bases"),
    )


def histogram_order(groups: Sequence[str] = (), samples: Sequence[str] | None = None) -> list[Column]:
    """How a histogram's rows follow: samples as given (else by name), groups in their order, ambiguous, unclassified, then lengths."""
    return [in_order("sample", samples), in_order("group", [*groups, AMBIGUOUS, UNCLASSIFIED]), F.asc("length")]


def binned(hist: DataFrame, step: int, lo: int = 0, hi: int | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """sample, bin, n and density (n / step) of bins that begin from lo to hi, with a density from least to most."""
    bins = hist.groupBy("sample", (F.floor(F.col("length") / step) * step).alias("bin")).agg(F.sum("count").alias("n"))
    bins = bins.withColumn("density", F.col("n") / step).filter(F.col("bin") >= lo)
    for limit, outside in ((hi, F.col("bin") > F.lit(hi)), (least, F.col("density") < F.lit(least)), (most, F.col("density") > F.lit(most))):
        if limit is not None:
            bins = bins.filter(~outside)
    return bins


def kde(hist: DataFrame, points: int = 50, bandwidth: float | None = None, lo: int = 0, hi: int | None = None) -> DataFrame:
    """Gaussian kernel density of lengths by sample, times its number of reads, at `points` places from its least to its greatest length.

    Scott's bandwidth unless one is given; lengths below lo or above hi do not count; lengths weigh by their
    counts, so no row is expanded. Samples with one length have none.
    """
    within = hist.filter(F.col("length") >= lo)
    by_length = (within if hi is None else within.filter(F.col("length") <= hi)).groupBy("sample", "length").agg(F.sum("count").alias("w"))
    facts = by_length.groupBy("sample").agg(F.sum("w").alias("n"), F.min("length").alias("lo"), F.max("length").alias("hi"), F.sum(F.col("w") * F.col("length")).alias("s1"), F.sum(F.col("w") * F.col("length") * F.col("length")).alias("s2"))
    var = (F.col("s2") - F.col("s1").cast("double") * F.col("s1") / F.col("n")) / (F.col("n") - 1)
    facts = facts.filter("n > 1 AND lo < hi").select("sample", "n", "lo", "hi", (F.sqrt(var) * F.pow(F.col("n").cast("double"), F.lit(-0.2)) if bandwidth is None else F.lit(float(bandwidth))).alias("h"))
    grid = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    grid = grid.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("length")) / F.col("h")
    # a row for each place and distinct length, summed map-side
    summed = by_length.join(sides.bounded(grid), "sample").groupBy("sample", "i", "x", "h").agg(F.sum(F.col("w") * F.exp(-z * z / 2)).alias("s"))
    return summed.select("sample", "i", "x", (F.col("s") / (F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def with_sample_reads(hist: DataFrame) -> DataFrame:
    """hist and sample_reads: all reads of the sample, over its groups. Rows are a histogram's lines."""
    return hist.withColumn("sample_reads", F.sum("count").over(Window.partitionBy("sample")).cast("long"))
