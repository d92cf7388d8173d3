"""The three analyses and index building over files, as one call each; DataFrames out, text at the caller's wish."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.operators import classify as C
from kmerlake.operators import containment as Q
from kmerlake.operators import lenhist as L
from kmerlake.operators import targets as T
from kmerlake.plans.params import check_fraction, check_groups, check_k_s, parse_bases
from kmerlake.sources import fastx, index, paths, storage


def _is_index(path: str) -> bool:
    return storage.is_dir(f"{path}/meta")


def _reads(spark: SparkSession, samples: Sequence[str], names: Sequence[str] | None, limit: int | str | None) -> DataFrame:
    """Records of the samples; what lies behind a limit is not opened."""
    return fastx.read_samples(spark, samples, names, parse_bases(limit) if isinstance(limit, str) else limit, numbers=False)


def sample_order(samples: Sequence[str], names: Sequence[str] | None) -> list[str]:
    """Samples as given, which is how reports follow."""
    return list(names) if names is not None else [paths.sample_name(p) for p in samples]


def read_targets(spark: SparkSession, path: str | Sequence[str], individual: bool = False) -> DataFrame:
    """Records with target_idx and target. A folder's files and folders are a target each; of a file, or of several files
    in their order, each record (`individual`), or all together under the first file's name if there are several."""
    files = [path] if isinstance(path, str) else list(path)
    if len(files) == 1 and storage.is_dir(files[0]):
        records, _ = fastx.read_groups(spark, files[0], numbers=False)
        return records.withColumnRenamed("group_idx", "target_idx").withColumnRenamed("group", "target")
    records = fastx.read_fastx(spark, [("", i, p) for i, p in enumerate(files)])
    if not individual and len(records.select("rec_idx").take(2)) > 1:
        return records.withColumn("target_idx", F.lit(0).cast("long")).withColumn("target", F.lit(paths.sample_name(files[0])))
    number = F.shiftleft(F.col("file_idx").cast("long"), 40) + F.col("rec_idx")
    return records.withColumn("target_idx", number).withColumn("target", F.col("seq_id")).drop("file_idx", "rec_idx")


def load_targets(spark: SparkSession, path: str | Sequence[str], k: int = 31, s: int = 9, individual: bool = False, fraction: float | None = None, background: Sequence[str] = (), discriminatory: bool = False, positions: bool = False, order: str | None = None, notes: dict | None = None) -> tuple[T.Targets, int, int, str | None]:
    """(targets, k, s, order) from an index or sequence files, filtered in the fixed order."""
    if isinstance(path, str) and _is_index(path):
        found, meta = index.load_targets(spark, path, fraction, positions)
        k, s, order = meta["k"], meta["s"], meta["smer_order"]
    else:
        check_k_s(k, s)
        found = T.build(read_targets(spark, path, individual), k, s, check_fraction(1.0 if fraction is None else fraction), order, notes)
    if background:
        found = T.Targets(found.info, T.mask(found.kmers, background_hits(spark, found.kmers, background, k, s, order)))
    if discriminatory:
        found = T.Targets(found.info, T.discriminatory(found.kmers, found.info.count()))
    return found, k, s, order


def background_hits(spark: SparkSession, tk: DataFrame, inputs: Sequence[str], k: int, s: int, order: str | None = None) -> DataFrame:
    files = [("background", i, p) for i, p in enumerate(paths.background(inputs))]
    return T.background_hits_of(tk, fastx.read_fastx(spark, files, numbers=False), k, s, order)


def query(spark: SparkSession, targets: str | Sequence[str], samples: Sequence[str], *, k: int = 31, s: int = 9, individual: bool = False, confidence: bool = False, discriminatory: bool = False, fraction: float | None = None, thresholds: Sequence[int] = (10,), background: Sequence[str] = (), limit: int | str | None = None, names: Sequence[str] | None = None, order: str | None = None, totals: bool = False, sort: str | None = None, notes: dict | None = None) -> DataFrame:
    """limit: bases of each sample, also as text (`10M`). totals: is_total and a TOTAL row for each sample. sort: rows in a report's order (containment.SORTS), samples as given. notes: gets the figures of the run (targets, reads, k-mers found), without jobs of their own."""
    found, k, s, order = load_targets(spark, targets, k, s, individual, fraction, background, discriminatory, confidence, order, notes)
    out = Q.containment(found, _reads(spark, samples, names, limit), k, s, thresholds, confidence, order, notes=notes)
    if totals:
        out = Q.with_totals(out, thresholds)
    if sort is None:
        return out
    flagged = out if totals else out.withColumn("is_total", F.lit(False))
    ordered = flagged.orderBy(*Q.report_order(sort, sample_order(samples, names)))
    return ordered if totals else ordered.drop("is_total")


def dump_syncmers(spark: SparkSession, targets: str | Sequence[str], *, k: int = 31, s: int = 9, individual: bool = False, fraction: float | None = None, background: Sequence[str] = (), discriminatory: bool = False, order: str | None = None) -> DataFrame:
    found, k, _, _ = load_targets(spark, targets, k, s, individual, fraction, background, discriminatory, True, order)
    return T.dump(found.kmers, k)


def load_groups(spark: SparkSession, path: str, k: int, s: int, discriminatory: bool, order: str | None) -> tuple[DataFrame, DataFrame, int, int, str | None, int | None]:
    """(index of masks, groups, k, s, order, the most k-mers it may have, if that is known) from an index or a folder of groups."""
    n_kmers = None
    if _is_index(path):
        found = index.load(spark, path, index.CLASSIFY)
        kmers, groups, k, s, order, n_kmers = found.kmers, found.names, found.meta["k"], found.meta["s"], found.meta["smer_order"], found.meta["n_kmers"]
    else:
        check_k_s(k, s)
        records, names = fastx.read_groups(spark, path, numbers=False)
        check_groups(len(names))
        groups = spark.createDataFrame(list(enumerate(names)), "group_idx int, group string")
        kmers = C.mask_index(records, k, s, order)
    return (C.discriminatory(kmers) if discriminatory else kmers), groups, k, s, order, n_kmers


def _numbered(reads: DataFrame) -> DataFrame:
    """Reads under a number that is unique in the sample, beside the name that may not be."""
    return reads.withColumn("read_name", F.col("seq_id")).withColumn("seq_id", F.concat_ws(":", "file_idx", "rec_idx", "seq_id"))


def classify(spark: SparkSession, groups: str, samples: Sequence[str], *, k: int = 31, s: int = 9, discriminatory: bool = False, abs_threshold: int = 1, rel_threshold: float = 0.0, limit: int | str | None = None, names: Sequence[str] | None = None, per_seq: bool = False, order: str | None = None) -> DataFrame:
    """A row for each read (`per_seq`), or for each sample and group in a report's order, samples as given."""
    kmers, known, k, s, order, n_kmers = load_groups(spark, groups, k, s, discriminatory, order)
    found = C.per_sequence(_numbered(_reads(spark, samples, names, limit)), kmers, known, k, s, abs_threshold, rel_threshold, order, n_kmers)
    if per_seq:
        return found.withColumn("seq_id", F.regexp_replace("seq_id", r"^\d+:\d+:", ""))
    return C.summary(C.buckets(found), known).orderBy(*C.summary_order(sample_order(samples, names)))


def lenhist(spark: SparkSession, groups: str, samples: Sequence[str], *, k: int = 31, s: int = 9, discriminatory: bool = False, abs_threshold: int = 1, rel_threshold: float = 0.0, limit: int | str | None = None, names: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """groups `-`: one bucket for all reads, no k-mers."""
    reads = _numbered(_reads(spark, samples, names, limit))
    if groups == "-":
        return L.histogram(L.all_in_one(reads))
    kmers, known, k, s, order, n_kmers = load_groups(spark, groups, k, s, discriminatory, order)
    return L.histogram(C.buckets(C.per_sequence(reads, kmers, known, k, s, abs_threshold, rel_threshold, order, n_kmers)))


def build_query_index(spark: SparkSession, targets: str | Sequence[str], out: str, *, k: int = 31, s: int = 9, individual: bool = False, positions: bool = False, fraction: float = 1.0, background: Sequence[str] = (), order: str | None = None, form: str = "parquet", buckets: int | None = None) -> None:
    found, k, s, _ = load_targets(spark, targets, k, s, individual, fraction, background, order=order)
    index.save_query_index(spark, out, found, k, s, fraction, positions, order or ("md5" if s <= 9 else "mix"), form, buckets)


def build_classify_index(spark: SparkSession, groups: str, out: str, *, k: int = 31, s: int = 9, order: str | None = None, form: str = "parquet", buckets: int | None = None) -> None:
    kmers, known, k, s, order, _ = load_groups(spark, groups, k, s, False, order)
    index.save_classify_index(spark, out, kmers, known, k, s, order or ("md5" if s <= 9 else "mix"), form, buckets)


def index_info(spark: SparkSession, path: str) -> DataFrame:
    return index.info(spark, path)
