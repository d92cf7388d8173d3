"""Containment of targets in samples: depth counts, per-target statistics, totals, report order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.functions import stats
from kmerlake.operators import prefilter, prefix, sides
from kmerlake.operators.syncmers import syncmers
from kmerlake.operators.targets import Targets, distinct_kmers, union_kmers
from kmerlake.plans.params import MAX_DEPTH, normalise_thresholds
from kmerlake.sources import shared

STRETCH = 1 << 20  # bases
STRETCH_HITS = 1 << 16
SORTS = ("containment", "target", "sample", "input")


def limit_bases(reads: DataFrame, limit: int, order: Sequence[str], by: str = "sample") -> DataFrame:
    """Reads of each sample, in order, until its reads before have `limit` bases. The last column of order is an integer.

    Sums go by blocks of records: blocks wholly before the limit stay as they are, those beyond it go, and
    reads are put in order within the block that reaches it alone.
    """
    dealt = prefix.with_block_sums(reads, by, order)
    inside = Window.partitionBy(by, *order[:-1], prefix.BLOCK).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.filter(F.col(prefix.BEFORE) < limit)
    whole = near.filter(F.col(prefix.BEFORE) + F.col(prefix.TOTAL) < limit)
    last = near.filter(F.col(prefix.BEFORE) + F.col(prefix.TOTAL) >= limit)
    last = last.withColumn("_inside", F.coalesce(F.sum(F.length("seq")).over(inside), F.lit(0))).filter(F.col(prefix.BEFORE) + F.col("_inside") < limit)
    return whole.select(*reads.columns).unionByName(last.select(*reads.columns))


def tallied(reads: DataFrame, tk: DataFrame, k: int, s: int, order: str | None = None) -> DataFrame:
    """reads: sample, seq. Gives sample, kmer, n of target k-mers and, without a k-mer, sample, seqs, bases: one pass for both.

    K-mers of no target are dropped before anything is shuffled: by the targets themselves if they may be broadcast,
    else by a filter in the generator that lets few others pass, and then by an exact join.
    """
    side, rows = sides.sized(union_kmers(tk), tk)
    small = rows <= sides.BROADCAST_ROWS
    found = syncmers(reads.select("sample", "seq"), k, s, order=order, tally=True, only=None if small else prefilter.build(side, rows))
    if small:
        known = F.broadcast(side.withColumn("_known", F.lit(True)))
        found = found.join(known, "kmer", "left").filter("kmer IS NULL OR _known")
    # counted before an exact join, so that a frequent k-mer comes once from each task
    counts = found.groupBy("sample", "kmer").agg(F.count("kmer").alias("n"), F.sum("seqs").alias("seqs"), F.sum("bases").alias("bases"))
    if small:
        return counts
    counts = shared.keep(counts, "counts")
    return counts.filter("kmer IS NULL").unionByName(counts.join(side.hint("shuffle_hash"), "kmer", "left_semi").select(*counts.columns))


def abundance(reads: DataFrame, tk: DataFrame, k: int, s: int, order: str | None = None) -> DataFrame:
    """reads: sample, seq. Gives sample, kmer, depth of target k-mers. Others are dropped before anything is shuffled."""
    return _depths(tallied(reads, tk, k, s, order))


def _depths(counts: DataFrame) -> DataFrame:
    return counts.filter("kmer IS NOT NULL").select("sample", "kmer", F.least("n", F.lit(MAX_DEPTH)).cast("long").alias("depth"))


def depths(occurrences: DataFrame) -> DataFrame:
    """sample, kmer rows to saturating counts."""
    return occurrences.groupBy("sample", "kmer").agg(F.least(F.count("*"), F.lit(MAX_DEPTH)).cast("long").alias("depth"))


def sample_stats(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample").agg(F.count("*").alias("sample_seqs"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("sample_bases"))


def _hit_stats(by_depth: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Over counts of each depth, of which there are few, and not over single k-mers."""
    above = [F.sum(F.when(F.col("depth") >= t, F.col("n")).otherwise(0)).alias(f"containment{t}_hits") for t in thresholds]
    return by_depth.groupBy("sample", "target_idx").agg(F.sum("n").alias("containment1_hits"), *above, F.percentile("depth", F.lit(0.5), F.col("n")).alias("median_nz_abundance"))


def depth_histogram(td: DataFrame, abund: DataFrame) -> DataFrame:
    """sample, target_idx, depth, n; depth 0 is what no row says."""
    return td.join(abund, "kmer").groupBy("sample", "target_idx", "depth").agg(F.count("*").alias("n"))


def depth_modes(hist: DataFrame) -> DataFrame:
    """sample, target_idx, mode, at_mode, after_mode: the most frequent depth (the larger of ties), its count and that of the next."""
    w = Window.partitionBy("sample", "target_idx").orderBy("depth").rangeBetween(1, 1)
    after = hist.withColumn("_next", F.coalesce(F.sum("n").over(w), F.lit(0)))
    best = after.groupBy("sample", "target_idx").agg(F.max(F.struct("n", "depth", "_next")).alias("m"))
    return best.select("sample", "target_idx", F.col("m.depth").alias("mode"), F.col("m.n").alias("at_mode"), F.col("m._next").alias("after_mode"))


def numbered_once(tk: DataFrame) -> DataFrame:
    """target_idx, kmer, i (from 1, by place) of the k-mers that stand once in their target, and n, how many it has. No task holds a target."""
    once = tk.groupBy("target_idx", "kmer").agg(F.count("*").alias("_n"), F.min("pos").alias("pos")).filter("_n = 1")
    return prefix.numbered(once.select("target_idx", "kmer", "pos"), "target_idx", "pos", STRETCH).select("target_idx", "kmer", "i", "n")


def run_counts(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """hits: keys, i (once each). Gives keys, hits, runs of neighbouring i, and the first and last i.

    Runs are counted in stretches of numbers, then those that go on over a border are joined.
    """
    cut = hits.withColumn("_stretch", F.floor(F.col("i") / STRETCH_HITS))
    near = Window.partitionBy(*keys, "_stretch").orderBy("i")
    fresh = F.coalesce((F.col("i") - F.lag("i").over(near) > 1).cast("long"), F.lit(1))
    parts = cut.withColumn("_fresh", fresh).groupBy(*keys, "_stretch").agg(F.count("*").alias("hits"), F.sum("_fresh").alias("runs"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    goes_on = (F.col("lo") - F.lag("hi").over(Window.partitionBy(*keys).orderBy("_stretch")) == 1).cast("long")
    joined = parts.withColumn("runs", F.col("runs") - F.coalesce(goes_on, F.lit(0)))
    return joined.groupBy(*keys).agg(F.sum("hits").alias("hits"), F.sum("runs").alias("runs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def all_runs() -> Column:
    """Runs of hits and of misses among n numbers, from run_counts; one if there is no hit."""
    both = 2 * F.col("runs") - 1 + (F.col("lo") > 1).cast("long") + (F.col("hi") < F.col("n")).cast("long")
    return F.coalesce(both, F.lit(1)).cast("long")


def patchiness(tk: DataFrame, samples: DataFrame, abund: DataFrame) -> DataFrame:
    """sample, target_idx, z, p: do a target's k-mers that were found cluster along it? Over k-mers that stand once in it. samples: a report's, so few.

    Those are numbered once; only the ones that a sample has are joined, and a gap in their numbers is a run of misses.
    """
    once = numbered_once(tk)
    sizes = once.groupBy("target_idx").agg(F.max("n").alias("n"))
    per = run_counts(abund.select("sample", "kmer").join(once.drop("n"), "kmer").select("sample", "target_idx", "i"), ["sample", "target_idx"])
    # few samples by few targets: the report itself
    sums = sizes.crossJoin(samples.select("sample")).join(per, ["sample", "target_idx"], "left")
    sums = sums.select("sample", "target_idx", "n", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), all_runs().alias("runs"))
    z = stats.runs_z(F.col("n"), F.col("hits"), F.col("runs"))
    return sums.withColumn("z", z).withColumn("p", stats.normal_survival(F.col("z")))


def containment(targets: Targets, reads: DataFrame, k: int, s: int, thresholds: Sequence[int] = (10,), confidence: bool = False, order: str | None = None, abund: DataFrame | None = None, notes: dict | None = None) -> DataFrame:
    """A row for each sample and target, also for those without a hit. reads: sample, seq, which are read once.

    The generator's counts are written and used from there, and so are the counts of each depth, on which all figures rest.
    notes: gets reads, read_bases, kmers_found (distinct, summed over samples) and kmer_hits as the counts are written.
    """
    thresholds = normalise_thresholds(thresholds)
    if abund is None:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        counts = shared.keep(tallied(reads, targets.kmers, k, s, order), "depths", notes, reads=total("seqs"), read_bases=total("bases"), kmers_found=F.count("kmer"), kmer_hits=total("n"))
        abund = _depths(counts)
        per_sample = counts.filter("kmer IS NULL").select("sample", F.col("seqs").alias("sample_seqs"), F.col("bases").alias("sample_bases"))
    else:
        per_sample = sample_stats(reads)
    td = distinct_kmers(targets.kmers)
    sizes = td.groupBy("target_idx").agg(F.count("*").alias("target_kmers"))
    by_depth = depth_histogram(td, abund)
    if confidence:
        by_depth = shared.keep(by_depth, "histogram")
    # few samples by few targets: the report itself
    per_sample = sides.bounded(per_sample, per_sample.count())
    grid = targets.info.join(sizes, "target_idx", "left").crossJoin(per_sample)
    found = grid.join(_hit_stats(by_depth, thresholds), ["sample", "target_idx"], "left")
    every = [1, *thresholds]
    n = F.coalesce("target_kmers", F.lit(0)).cast("long")
    hits = {t: F.coalesce(F.col(f"containment{t}_hits"), F.lit(0)).cast("long") for t in every}
    out = found.select("sample", "target_idx", "target", n.alias("target_kmers"), F.col("length").alias("target_length"), "sample_seqs", "sample_bases", F.coalesce("median_nz_abundance", F.lit(0.0)).alias("median_nz_abundance"), *(h.alias(f"containment{t}_hits") for t, h in hits.items()))
    for t in every:
        out = out.withColumn(f"containment{t}", stats.ratio(F.col(f"containment{t}_hits"), F.col("target_kmers")))
    if confidence:
        for t in every:
            lo, hi = stats.wilson(F.col(f"containment{t}_hits"), F.col("target_kmers"))
            out = out.withColumns({f"containment{t}_lo": lo, f"containment{t}_hi": hi})
        modes = depth_modes(by_depth)
        patchy = patchiness(targets.kmers, per_sample, abund).select("sample", "target_idx", F.col("z").alias("patchiness_z"), F.col("p").alias("patchiness_p"))
        out = out.join(modes, ["sample", "target_idx"], "left").join(patchy, ["sample", "target_idx"], "left")
        rate = stats.depth_rate(F.col("target_kmers"), F.col("containment1_hits"), F.col("median_nz_abundance"), F.col("mode"), F.col("at_mode"), F.col("after_mode"))
        out = out.withColumn("depth_rate", rate)
        out = out.withColumn("ani_est", stats.identity(F.col("containment1"), F.col("depth_rate"), F.col("target_kmers"), k)).drop("mode", "at_mode", "after_mode")
    return out


def with_totals(result: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Adds is_total and a TOTAL row for each sample: sums over its targets, no median, length 0."""
    every = [1, *normalise_thresholds(thresholds)]
    sums = [F.sum(c).alias(c) for c in ("target_kmers", *(f"containment{t}_hits" for t in every))]
    total = result.groupBy("sample", "sample_seqs", "sample_bases").agg(*sums)
    total = total.select("*", F.lit("TOTAL").alias("target"), F.lit(0).cast("long").alias("target_length"), F.lit(True).alias("is_total"))
    for t in every:
        total = total.withColumn(f"containment{t}", stats.ratio(F.col(f"containment{t}_hits"), F.col("target_kmers")))
    return result.withColumn("is_total", F.lit(False)).unionByName(total, allowMissingColumns=True)


def in_order(column: str, given: Sequence[str] | None) -> Column:
    """Rank of a column's values as given, others behind; by name if nothing is given."""
    if given is None:
        return F.asc(column)
    at = F.array_position(F.array(*map(F.lit, given)), F.col(column))
    return F.when(at > 0, at).otherwise(F.lit(len(given) + 1)).asc()


def report_order(sort: str = "containment", samples: Sequence[str] | None = None) -> list[Column]:
    """How a report's rows follow: samples in the order given (else by name), TOTAL last, ties in the targets' order."""
    if sort not in SORTS:
        raise ValueError(f"sort is one of {', '.join(SORTS)}, not {sort!r}")
    inner = {"containment": [F.desc("containment1")], "target": [F.asc("target")], "sample": [F.asc("target")], "input": []}[sort]
    return [in_order("sample", samples), F.asc("sample"), F.asc("is_total"), *inner, F.asc_nulls_last("target_idx")]


def found_kmers(abund: DataFrame) -> DataFrame:
    """Distinct target k-mers found, by sample."""
    return abund.groupBy("sample").agg(F.count("*").alias("kmers_found"))
