"""Prebuilt k-mer tables: query indexes (targets) and classification indexes (a mask of groups for each k-mer).

{path}/meta is one row: kind, version, k, s, smer order, fraction, with_positions, n_names, n_kmers, form, buckets.
{path}/names and {path}/kmers hold the rest; k-mers are clustered, so joins and reads of a few prune files.
Forms: "parquet"; "packed" (sources.packed), half the bytes, checked against cuts; "buckets", Parquet in hash buckets by
k-mer, so that joins with it shuffle the other side only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from kmerlake.operators import masks, sides
from kmerlake.operators import targets as T
from kmerlake.sources import packed, storage

VERSION = 2
QUERY, CLASSIFY = "query", "classify"
META = "kind string, version int, k int, s int, smer_order string, fraction double, with_positions boolean, n_names long, n_kmers long, form string, buckets int"
FORMS = ("parquet", "packed", "buckets")


@dataclass
class Index:
    meta: Row
    names: DataFrame
    kmers: DataFrame


def _table(path: str) -> str:
    """The name under which a session knows the buckets."""
    return "kmerlake_" + hashlib.md5(storage.plain(path).encode(), usedforsecurity=False).hexdigest()


def _kmers(spark: SparkSession, path: str, form: str, buckets: int) -> DataFrame:
    if form == "packed":
        return packed.read(spark, f"{path}/kmers")
    if form != "buckets":
        return spark.read.parquet(f"{path}/kmers")
    if not spark.catalog.tableExists(_table(path)):
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/kmers").schema)
        spark.sql(f"CREATE TABLE {_table(path)} ({fields}) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS LOCATION '{path}/kmers'")
    return spark.table(_table(path))


def _write(spark: SparkSession, path: str, meta: dict, names: DataFrame, kmers: DataFrame, form: str, buckets: int | None) -> None:
    if form not in FORMS:
        raise ValueError(f"form is one of {', '.join(FORMS)}, not {form!r}")
    names.write.mode("errorifexists").parquet(f"{path}/names")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if form == "buckets":
        dealt = kmers.repartition(buckets, "kmer")
        dealt.write.bucketBy(buckets, "kmer").sortBy("kmer").option("path", f"{path}/kmers").mode("errorifexists").format("parquet").saveAsTable(_table(path))
    else:
        ordered = kmers.repartitionByRange("kmer").sortWithinPartitions("kmer")
        if form == "packed":
            packed.write(ordered, f"{path}/kmers", meta["k"])
        else:
            ordered.write.mode("errorifexists").parquet(f"{path}/kmers")
    n_names, n_kmers = spark.read.parquet(f"{path}/names").count(), _kmers(spark, path, form, buckets).count()
    row = Row(**meta, version=VERSION, n_names=n_names, n_kmers=n_kmers, form=form, buckets=buckets if form == "buckets" else 0)
    fields = [f.split()[0] for f in META.split(", ")]
    # written last: an index without meta is not one
    spark.createDataFrame([tuple(row[f] for f in fields)], META).coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")


def save_query_index(spark: SparkSession, path: str, found: T.Targets, k: int, s: int, fraction: float = 1.0, positions: bool = False, order: str = "md5", form: str = "parquet", buckets: int | None = None) -> None:
    number = F.col("target_idx").cast("long").alias("target_idx")
    kmers = found.kmers.select("kmer", number, "pos") if positions else found.kmers.select("kmer", number).distinct()
    _write(spark, path, {"kind": QUERY, "k": k, "s": s, "smer_order": order, "fraction": float(fraction), "with_positions": positions}, found.info, kmers, form, buckets)


def save_classify_index(spark: SparkSession, path: str, index: DataFrame, groups: DataFrame, k: int, s: int, order: str = "md5", form: str = "parquet", buckets: int | None = None) -> None:
    """index: kmer, group_idx rows or masks. groups: group_idx, group."""
    own = index if masks.is_mask(index) else masks.from_rows(index)
    _write(spark, path, {"kind": CLASSIFY, "k": k, "s": s, "smer_order": order, "fraction": 1.0, "with_positions": False}, groups.select("group_idx", "group"), own.select("kmer", "lo", "hi"), form, buckets)


def read_meta(spark: SparkSession, path: str) -> Row:
    try:
        rows = spark.read.parquet(f"{path}/meta").collect()  # one row
    except Exception as e:
        raise ValueError(f"Not an index: {path}") from e
    if len(rows) != 1 or rows[0]["version"] != VERSION:
        raise ValueError(f"Unsupported index version in {path}")
    return rows[0]


def load(spark: SparkSession, path: str, kind: str) -> Index:
    """Checks the kind, and that no part is missing rows."""
    meta = read_meta(spark, path)
    if meta["kind"] != kind:
        raise ValueError(f"{path} is a {meta['kind']} index, not a {kind} index")
    names, kmers = spark.read.parquet(f"{path}/names"), _kmers(spark, path, meta["form"], meta["buckets"])
    if names.count() != meta["n_names"] or kmers.count() != meta["n_kmers"]:
        raise ValueError(f"Truncated index: {path}")
    return Index(meta, names, kmers)


def load_targets(spark: SparkSession, path: str, fraction: float | None = None, need_positions: bool = False) -> tuple[T.Targets, Row]:
    found = load(spark, path, QUERY)
    if need_positions and not found.meta["with_positions"]:
        raise ValueError("The index has no positions; build it with positions=True")
    if fraction is not None and fraction != found.meta["fraction"]:
        raise ValueError(f"The index was built with fraction {found.meta['fraction']}, not {fraction}")
    kmers = found.kmers if "pos" in found.kmers.columns else found.kmers.withColumn("pos", F.lit(None).cast("long"))
    named = kmers.join(sides.bounded(found.names.select("target_idx", "target"), found.meta["n_names"]), "target_idx")
    return T.Targets(found.names, named.select("target_idx", "target", "pos", "kmer")), found.meta


def info(spark: SparkSession, path: str) -> DataFrame:
    """The meta row with the k-mers of each name: name, n_kmers beside the index's own figures."""
    meta = read_meta(spark, path)
    kmers = _kmers(spark, path, meta["form"], meta["buckets"])
    key, name = ("target_idx", "target") if meta["kind"] == QUERY else ("group_idx", "group")
    total = kmers.agg(F.count("*").alias("total_kmers")) if meta["kind"] == QUERY else kmers.agg(F.coalesce(F.sum(masks.n_groups()), F.lit(0)).cast("long").alias("total_kmers"))
    rows = kmers if meta["kind"] == QUERY else masks.to_rows(kmers)
    per = rows.groupBy(key).agg(F.count_distinct("kmer").alias("n_kmers"))
    meta = spark.read.parquet(f"{path}/meta").drop("n_kmers").crossJoin(total)  # one row each
    names = spark.read.parquet(f"{path}/names").select(key, F.col(name).alias("name")).join(per, key, "left")
    return names.select("name", F.coalesce("n_kmers", F.lit(0)).alias("n_kmers")).crossJoin(F.broadcast(meta))
