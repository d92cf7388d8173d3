"""Registered queries of the core engine: each operator over the driver's tables. Their SQL twins are in plans.oracles; queries over files are in plans.files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.functions import dna, stats, text
from kmerlake.operators import classify as C
from kmerlake.operators import containment as Q
from kmerlake.operators import lenhist as L
from kmerlake.operators import masks, prefix, reshape
from kmerlake.operators import targets as T
from kmerlake.operators.syncmers import split_long, syncmers, syncmers_native
from kmerlake.plans import files, oracles, tables
from kmerlake.sources import index

K, S = 31, 9
THRESHOLDS = (10, 2, 1)
QUERIES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _targets(spark: SparkSession, d: str) -> T.Targets:
    return T.build(tables.targets(spark, d), K, S)


def _abundance(spark: SparkSession, d: str, t: T.Targets) -> DataFrame:
    return Q.abundance(tables.reads(spark, d), t.kmers, K, S)


def _containment(spark: SparkSession, d: str, confidence: bool = False) -> DataFrame:
    return Q.containment(_targets(spark, d), tables.reads(spark, d), K, S, THRESHOLDS, confidence)


# generators


@_query
def syncmers_documents(spark, d):
    return syncmers(tables.reads(spark, d).select("seq_id", "seq"), K, S, positions=True, text=True)


@_query
def syncmers_positions(spark, d):
    return T.dump(_targets(spark, d).kmers, K)


@_query
def syncmers_dataframe_form(spark, d):
    t = tables.targets(spark, d)
    return syncmers_native(t, K, S, key="target_idx").join(F.broadcast(t.select("target_idx", "target")), "target_idx").select("target", F.col("pos").alias("position"), "kmer")


@_query
def syncmers_k33(spark, d):
    found = syncmers(tables.targets(spark, d).select("target_idx", "seq"), 33, S, positions=True)
    return found.withColumn("kmer", dna.decode("kmer", 33))


@_query
def syncmers_k61(spark, d):
    """Two words a k-mer."""
    found = syncmers(tables.targets(spark, d).select("target_idx", "seq"), 61, S, positions=True)
    return found.withColumn("kmer", dna.decode("kmer", 61))


@_query
def abundance_k61(spark, d):
    t = T.build(tables.targets(spark, d), 61, S)
    return Q.abundance(tables.reads(spark, d), t.kmers, 61, S).select("sample", dna.decode("kmer", 61).alias("kmer"), "depth")


@_query
def syncmers_rolling(spark, d):
    """s-mers ranked by a rolling hash of both strands."""
    return syncmers(tables.targets(spark, d).select("target_idx", "seq"), K, 11, positions=True, order="rolling", text=True)


@_query
def syncmers_rolling_dataframe_form(spark, d):
    t = tables.targets(spark, d)
    return syncmers_native(t, K, 11, key="target_idx", order="rolling")


@_query
def syncmers_k15(spark, d):
    return syncmers(tables.turns(spark, d).select("conv_id", "turn", "seq"), 15, 7, positions=True, text=True)


@_query
def syncmers_chunked(spark, d):
    pieces = split_long(tables.reads(spark, d).select("seq_id", "seq"), K, 1000)
    found = syncmers(pieces, K, S, positions=True, text=True)
    return found.select("seq_id", (F.col("chunk_start") + F.col("pos")).alias("pos"), "kmer")


@_query
def ambiguous_skip(spark, d):
    r = tables.turns(spark, d)
    n = syncmers(r.select("conv_id", "turn", "seq"), K, S).groupBy("conv_id", "turn").agg(F.count("*").alias("selected"))
    windows = F.greatest(F.length("seq") - (K - 1), F.lit(0)).cast("long")
    return r.join(n, ["conv_id", "turn"], "left").select("conv_id", "turn", windows.alias("windows"), F.coalesce("selected", F.lit(0)).alias("selected"), dna.is_unambiguous(F.col("seq")).alias("unambiguous"))


@_query
def kmer_decode(spark, d):
    packed = syncmers(tables.targets(spark, d).select("target_idx", "seq"), K, S)
    return packed.select("target_idx", dna.decode("kmer", K).alias("kmer"), dna.revcomp(dna.decode("kmer", K)).alias("reverse_complement"))


# targets


@_query
def fracminhash(spark, d):
    return T.dump(T.build(tables.targets(spark, d), K, S, fraction=0.1).kmers, K)


@_query
def target_distinct(spark, d):
    t = _targets(spark, d)
    n = T.distinct_kmers(t.kmers).groupBy("target_idx").agg(F.count("*").alias("n"))
    return t.info.join(n, "target_idx", "left").select("target", "length", F.coalesce("n", F.lit(0)).alias("target_kmers"))


@_query
def target_union(spark, d):
    return T.union_kmers(_targets(spark, d).kmers).select(dna.decode("kmer", K).alias("kmer"))


@_query
def target_intersection(spark, d):
    """K-mers that two groups of targets share."""
    t = T.build(tables.merged_targets(spark, d), 7, 3).kmers
    return T.shared_kmers_of(t.filter("target_idx = 0"), t.filter("target_idx = 1")).select(dna.decode("kmer", 7).alias("kmer"))


@_query
def target_merge_offsets(spark, d):
    t = T.build(tables.merged_targets(spark, d), K, S)
    return T.dump(t.kmers, K).join(F.broadcast(t.info.select("target", "length")), "target")


@_query
def shared_kmers(spark, d):
    return T.shared_counts(_targets(spark, d).kmers)


@_query
def target_summary(spark, d):
    r = tables.merged_targets(spark, d)
    return _rounded(T.summary(r, T.build(r, K, S).kmers))


@_query
def discriminatory(spark, d):
    t = T.build(tables.merged_targets(spark, d), K, S)
    return T.dump(T.discriminatory(t.kmers, tables.N_GROUPS), K)


def _masked(spark, d, t):
    hits = T.background_hits_of(t.kmers, tables.reads(spark, d), K, S)
    return T.mask(t.kmers, hits)


@_query
def background_mask(spark, d):
    return T.dump(_masked(spark, d, _targets(spark, d)), K)


@_query
def background_hits(spark, d):
    hits = T.background_hits_of(_targets(spark, d).kmers, tables.reads(spark, d), K, S)
    return hits.agg(F.count("*").alias("masked_kmers"))


@_query
def mask_then_discriminate(spark, d):
    t = T.build(tables.merged_targets(spark, d), K, S)
    return T.dump(T.discriminatory(_masked(spark, d, t), tables.N_GROUPS), K)


@_query
def self_background(spark, d):
    t = _targets(spark, d)
    left = T.mask(t.kmers, T.background_hits(T.union_kmers(t.kmers), t.kmers))
    return left.agg(F.count("*").alias("target_kmers"))


# containment


@_query
def abundance(spark, d):
    return _abundance(spark, d, _targets(spark, d)).select("sample", dna.decode("kmer", K).alias("kmer"), "depth")


@_query
def abundance_saturated(spark, d):
    return Q.depths(tables.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_linestatus").alias("kmer")))


@_query
def kmers_found(spark, d):
    return Q.found_kmers(_abundance(spark, d, _targets(spark, d)))


@_query
def containment1(spark, d):
    found = Q.containment(_targets(spark, d), tables.reads(spark, d), K, S, ())
    return _rounded(found.select("sample", "target", "containment1", "containment1_hits", "target_kmers"))


@_query
def containment_thresholds(spark, d):
    return _rounded(_containment(spark, d).select("sample", "target", "containment1", "containment2", "containment2_hits", "containment10", "containment10_hits"))


@_query
def containment_by_source(spark, d):
    found = Q.containment(_targets(spark, d), tables.reads(spark, d, "source"), K, S, ())
    return _rounded(found.select("sample", "target", "containment1", "containment1_hits", "median_nz_abundance"))


@_query
def median_nz(spark, d):
    return _containment(spark, d).select("sample", "target", "median_nz_abundance")


@_query
def depth_histogram(spark, d):
    t = _targets(spark, d)
    return Q.depth_histogram(T.distinct_kmers(t.kmers), _abundance(spark, d, t))


@_query
def depth_mode(spark, d):
    t = _targets(spark, d)
    return Q.depth_modes(Q.depth_histogram(T.distinct_kmers(t.kmers), _abundance(spark, d, t)))


@_query
def total_rows(spark, d):
    out = Q.with_totals(_containment(spark, d), THRESHOLDS).filter("is_total")
    return _rounded(out.select("sample", "target", "target_kmers", "target_length", "containment1_hits", "containment1", "containment10_hits", "median_nz_abundance", "sample_seqs", "sample_bases"))


def _sorted(spark, d, sort):
    rows = Q.with_totals(_containment(spark, d), THRESHOLDS)
    # ranks of a report's rows: samples by targets
    rank = F.row_number().over(Window.orderBy(*Q.report_order(sort)))
    return rows.select(rank.cast("long").alias("rank"), "sample", "target")


@_query
def sort_containment(spark, d):
    return _sorted(spark, d, "containment")


@_query
def sort_target(spark, d):
    return _sorted(spark, d, "target")


@_query
def sort_input(spark, d):
    return _sorted(spark, d, "input")


@_query
def sort_samples_given(spark, d):
    """Samples in an order of the caller's, those not named behind."""
    rows = Q.with_totals(_containment(spark, d), THRESHOLDS)
    rank = F.row_number().over(Window.orderBy(*Q.report_order("target", ["fr", "en"])))
    return rows.select(rank.cast("long").alias("rank"), "sample", "target")


@_query
def wilson_ci(spark, d):
    lo, hi = stats.wilson(F.col("containment1_hits"), F.col("target_kmers"))
    return _rounded(_containment(spark, d).select("sample", "target", lo.alias("lo"), hi.alias("hi")))


@_query
def wilson_orders(spark, d):
    o = tables.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("x"))
    lo, hi = stats.wilson(F.col("x"), F.col("n"))
    return _rounded(o.select("o_custkey", "x", "n", lo.alias("lo"), hi.alias("hi")))


@_query
def erf_survival(spark, d):
    x = (F.col("l_extendedprice") - 30000) / 10000
    li = tables.table(spark, d, "lineitem")
    return _rounded(li.select("l_orderkey", "l_linenumber", stats.erf(x).alias("erf"), stats.normal_survival(x).alias("survival")))


@_query
def poisson_tail(spark, d):
    rate = F.col("l_quantity") / 10
    li = tables.table(spark, d, "lineitem")
    return _rounded(li.select("l_orderkey", "l_linenumber", *(stats.poisson_tail(rate, t).alias(f"at_least_{t}") for t in (1, 2, 5))))


@_query
def lambda_est(spark, d):
    return _rounded(_containment(spark, d, True).select("sample", "target", "depth_rate"))


@_query
def lambda_lines(spark, d):
    """The depth rate of counts that do have one: lines of an order as a depth, orders as k-mers."""
    lines = tables.table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("sample")).agg(F.count("*").alias("depth"))
    hist = lines.groupBy("sample", F.lit(0).alias("target_idx"), "depth").agg(F.count("*").alias("n"))
    sizes = lines.groupBy("sample").agg(F.count("*").alias("nonzero"), F.percentile("depth", F.lit(0.5)).alias("median"))
    m = Q.depth_modes(hist).join(sizes, "sample")
    rate = stats.depth_rate(F.col("nonzero"), F.col("nonzero"), F.col("median"), F.col("mode"), F.col("at_mode"), F.col("after_mode"))
    half = m.withColumn("depth_rate", rate).withColumn("containment", F.lit(0.5))
    return _rounded(half.select("sample", "mode", "at_mode", "after_mode", "depth_rate", stats.identity(F.col("containment"), F.col("depth_rate"), F.col("nonzero"), K).alias("ani_est")))


@_query
def ani_est(spark, d):
    return _rounded(_containment(spark, d, True).select("sample", "target", "ani_est"))


@_query
def runs_patchiness(spark, d):
    t = T.build(tables.merged_targets(spark, d), K, S)
    r = tables.reads(spark, d)
    return _rounded(Q.patchiness(t.kmers, r.select("sample").distinct(), Q.abundance(r, t.kmers, K, S)))


@_query
def runs_events(spark, d):
    """Do every third user's events cluster? By stretches of events, whatever a type's share."""
    e = tables.table(spark, d, "events").select("event_type", "event_id", (F.pmod("user_id", F.lit(3)) == 0).alias("hit"))
    e = prefix.numbered(e, "event_type", "event_id", Q.STRETCH_HITS)
    per = Q.run_counts(e.filter("hit").select("event_type", "i"), ["event_type"])
    g = e.groupBy("event_type").agg(F.count("*").alias("n")).join(per, "event_type", "left")
    g = g.select("event_type", "n", F.coalesce("hits", F.lit(0)).alias("hits"), Q.all_runs().alias("runs"))
    z = stats.runs_z(F.col("n"), F.col("hits"), F.col("runs"))
    return _rounded(g.select("event_type", "n", "hits", "runs", z.alias("z"), stats.normal_survival(z).alias("p")))


@_query
def query_full(spark, d):
    out = _containment(spark, d, True)
    return _rounded(out.select("sample", "target", "containment1", "containment1_hits", "containment1_lo", "containment1_hi", "containment2", "containment2_hits", "containment2_lo", "containment2_hi", "containment10", "containment10_hits", "ani_est", "patchiness_z", "patchiness_p", "median_nz_abundance", "target_kmers", "target_length", "sample_seqs", "sample_bases"))


@_query
def sample_stats(spark, d):
    return Q.sample_stats(tables.reads(spark, d, "source"))


@_query
def limit_bases(spark, d):
    return Q.limit_bases(tables.reads(spark, d, "source"), 20000, ["seq_id"]).select("sample", "seq_id", F.length("seq").alias("length"))


# classification


def _index(spark, d):
    return C.group_index(tables.groups(spark, d), K, S)


def _per_seq(spark, d, index_=None, **how):
    return C.per_sequence(tables.reads(spark, d, "source"), _index(spark, d) if index_ is None else index_, tables.group_names(spark), K, S, **how)


@_query
def group_index(spark, d):
    return _index(spark, d).select(dna.decode("kmer", K).alias("kmer"), "group_idx")


N_MASK_GROUPS = 100


@_query
def group_masks(spark, d):
    """Groups of each k-mer of many groups, by way of their bits."""
    many = tables.targets(spark, d).select(F.pmod(F.col("target_idx") * 7, F.lit(N_MASK_GROUPS)).cast("int").alias("group_idx"), "seq")
    found = C.mask_index(many, 15, 7)
    return found.select(dna.decode("kmer", 15).alias("kmer"), masks.n_groups().cast("long").alias("n_groups"), F.array_join(masks.groups_of().cast("array<string>"), ",").alias("groups"))


@_query
def group_unique(spark, d):
    return C.group_counts(_index(spark, d))


@_query
def classify_discriminatory(spark, d):
    return _per_seq(spark, d, C.discriminatory(_index(spark, d)))


@_query
def classify_per_seq(spark, d):
    return _per_seq(spark, d)


@_query
def classify_rel_threshold(spark, d):
    return _per_seq(spark, d, abs_threshold=2, rel_threshold=0.05)


@_query
def classify_rel_exact(spark, d):
    """A share that many reads have exactly: the quotient is what is compared."""
    return _per_seq(spark, d, rel_threshold=1 / 3)


@_query
def classify_abs0(spark, d):
    return _per_seq(spark, d, abs_threshold=0)


@_query
def classify_summary(spark, d):
    return _rounded(C.summary(C.buckets(_per_seq(spark, d)), tables.group_names(spark)).drop("bucket_idx"))


@_query
def classify_summary_order(spark, d):
    s = C.summary(C.buckets(_per_seq(spark, d)), tables.group_names(spark))
    w = Window.partitionBy("sample").orderBy(*C.summary_order()[1:])
    return s.select("sample", F.row_number().over(w).cast("long").alias("rank"), "group")


# length histograms and plots


@_query
def lenhist(spark, d):
    return L.histogram(C.buckets(_per_seq(spark, d)))


@_query
def lenhist_all(spark, d):
    return L.histogram(L.all_in_one(tables.turns(spark, d)))


@_query
def lenhist_sample_reads(spark, d):
    return L.with_sample_reads(L.histogram(L.all_in_one(tables.turns(spark, d)))).select("sample", "group", "length", "count", "sample_reads")


@_query
def lenhist_bins(spark, d):
    return _rounded(L.binned(L.histogram(L.all_in_one(tables.reads(spark, d, "source"))), 500))


@_query
def lenhist_bins_range(spark, d):
    """Bins whose start is within 250 and 3000 and that have two reads or more."""
    return _rounded(L.binned(L.histogram(L.all_in_one(tables.reads(spark, d, "source"))), 500, 250, 3000, least=0.004, most=0.5))


@_query
def lenhist_order(spark, d):
    h = L.histogram(C.buckets(_per_seq(spark, d)))
    w = Window.partitionBy("sample").orderBy(*L.histogram_order([f"group{i}" for i in range(tables.N_GROUPS)])[1:])
    return h.select("sample", F.row_number().over(w).cast("long").alias("rank"), "group", "length")


@_query
def kde_range(spark, d):
    return _rounded(L.kde(L.histogram(L.all_in_one(tables.turns(spark, d))), 20, 30.0, 50, 400), 6)


@_query
def kde(spark, d):
    return _rounded(L.kde(L.histogram(L.all_in_one(tables.turns(spark, d)))), 6)


@_query
def unpivot_decay(spark, d):
    return _rounded(reshape.decay(Q.with_totals(_containment(spark, d), THRESHOLDS)))


@_query
def concat_reports(spark, d):
    by_lang, by_source = (tables.reads(spark, d, c) for c in ("lang", "source"))
    a, b = (Q.sample_stats(r) for r in (by_lang, by_source))
    return a.unionByName(b.withColumn("run", F.lit("source")), allowMissingColumns=True)


@_query
def short_names(spark, d):
    out = Q.with_totals(_containment(spark, d), THRESHOLDS)
    return out.select("sample", "target", text.short_name(F.col("target"), "All targets").alias("display_name"), text.depth_label(F.col("median_nz_abundance")).alias("depth_label"))


@_query
def plot_totals(spark, d):
    """The TOTAL rows alone, for the samples asked for."""
    out = reshape.only_samples(Q.with_totals(_containment(spark, d), THRESHOLDS), ["en", "de"], totals=True)
    return _rounded(out.select("sample", "target", "target_kmers", "containment1_hits", "containment1"))


@_query
def plot_prep(spark, d):
    out = reshape.only_samples(Q.with_totals(_containment(spark, d), THRESHOLDS), ["en", "de"])
    ordered = reshape.first_appearance(out, "target", "target_idx")
    n = out.select(F.count_distinct("sample").alias("n_samples"))
    return _rounded(ordered.select("sample", "target", F.col("target_order").alias("target_idx"), "containment1").crossJoin(F.broadcast(n)))


# indexes and text


@_query
def index_roundtrip(spark, d):
    path = files.folder(spark)
    index.save_query_index(spark, path, _targets(spark, d), K, S, positions=True)
    t, _ = index.load_targets(spark, path, need_positions=True)
    return T.dump(t.kmers, K)


@_query
def index_packed(spark, d):
    """The binary form, written and read back, of targets with two words a k-mer."""
    path = files.folder(spark)
    index.save_query_index(spark, path, T.build(tables.targets(spark, d), 61, S), 61, S, positions=True, form="packed")
    t, _ = index.load_targets(spark, path, need_positions=True)
    return T.dump(t.kmers, 61)


@_query
def index_packed_classify(spark, d):
    """Reads classified by a binary index of masks."""
    path = files.folder(spark)
    index.save_classify_index(spark, path, C.mask_index(tables.groups(spark, d), K, S), tables.group_names(spark), K, S, form="packed")
    found = index.load(spark, path, index.CLASSIFY)
    return C.per_sequence(tables.reads(spark, d, "source"), found.kmers, found.names, K, S, n_kmers=found.meta["n_kmers"])


@_query
def index_buckets(spark, d):
    """Which groups the k-mers of reads have, by an index in buckets: only the reads' side is shuffled."""
    path = files.folder(spark)
    index.save_classify_index(spark, path, C.mask_index(tables.groups(spark, d), K, S), tables.group_names(spark), K, S, form="buckets")
    found = index.load(spark, path, index.CLASSIFY)
    hits = syncmers(tables.reads(spark, d).select("seq_id", "seq"), K, S).join(found.kmers.hint("shuffle_hash"), "kmer")
    return hits.select("seq_id", F.explode(masks.groups_of()).alias("group_idx")).groupBy("seq_id", "group_idx").agg(F.count("*").alias("n"))


@_query
def index_info(spark, d):
    path = files.folder(spark)
    index.save_classify_index(spark, path, _index(spark, d), tables.group_names(spark), K, S)
    return index.info(spark, path).select("name", "n_kmers", "kind", "k", "s", "n_names", "total_kmers")


@_query
def format_bp(spark, d):
    n = (F.col("o_totalprice") * F.col("o_orderkey")).cast("long")
    o = tables.table(spark, d, "orders").withColumn("n", n)
    return o.select("o_orderkey", text.format_bp(F.col("n")).alias("bp"), text.format_bp_per_sec(F.col("n").cast("double")).alias("rate"))


QUERIES |= files.QUERIES
ORACLES = oracles.ORACLES | files.ORACLES
