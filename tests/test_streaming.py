import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerlake.functions import dna
from kmerlake.operators import classify as C
from kmerlake.operators import containment as Q
from kmerlake.operators import targets as T
from kmerlake.plans.params import MAX_DEPTH
from kmerlake.streaming import depths, incremental
from tests.dna_data import random_dna

K, S = 31, 9
GENOME = random_dna(5000, 77)


def frames(spark):
    target = spark.createDataFrame([(0, "t", GENOME)], "target_idx long, target string, seq string")
    reads = spark.createDataFrame([(f"s{i % 2}", i, GENOME[i * 50 : i * 50 + 400]) for i in range(90)], "sample string, seq_id long, seq string")
    return T.build(target, K, S), reads


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streamed_depths_equal_batch(spark, tmp_path):
    targets, reads = frames(spark)
    reads.repartition(6).write.parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "reads"))
    got = run(incremental.streaming_abundance(stream, targets.kmers, K, S), "complete", "depths")
    want = Q.abundance(reads, targets.kmers, K, S)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0
    half = [Q.abundance(reads.filter(F.col("seq_id") % 3 == 0), targets.kmers, K, S), Q.abundance(reads.filter(F.col("seq_id") % 3 > 0), targets.kmers, K, S)]
    assert incremental.merged_depths(*half).exceptAll(want).count() == 0


def test_streamed_read_hits_equal_batch(spark, tmp_path):
    _, reads = frames(spark)
    reads.repartition(3).write.parquet(str(tmp_path / "reads"))
    groups = spark.createDataFrame([(0, GENOME[:2500]), (1, GENOME[2500:])], "group_idx int, seq string")
    kmers = C.group_index(groups, K, S)
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "reads"))
    got = run(incremental.streaming_read_hits(stream, kmers, K, S), "append", "hits")
    per = C.per_sequence(reads, kmers, spark.createDataFrame([(0, "a"), (1, "b")], "group_idx int, group string"), K, S)
    total = per.select(F.explode(F.split("hits", ",")).alias("h")).agg(F.sum(F.col("h").cast("long"))).first()[0]
    assert got.count() == total > 0


def test_windowed_stats(spark, tmp_path):
    rows = [("s", f"2024-01-01 00:{m:02d}:00", "ACGT") for m in range(30)]
    df = spark.createDataFrame(rows, "sample string, ts string, seq string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))
    got = run(incremental.windowed_sample_stats(stream, "ts", "1 minute", "10 minutes"), "complete", "windows").collect()
    assert sorted(r["sample_seqs"] for r in got) == [10, 10, 10] and all(r["sample_bases"] == 40 for r in got)


def target_kmers(spark, k):
    return T.build(spark.createDataFrame([(0, "t", GENOME)], "target_idx long, target string, seq string"), k, S).kmers


def by_kmer(df):
    return {(r["sample"], r["kmer"]): r["depth"] for r in df.collect()}


def step(updates, tmp_path):
    depths.start(updates, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
    return depths.latest(updates.sparkSession, str(tmp_path / "rows"), updates.schema)


@pytest.mark.parametrize("k", [K, 35])
def test_stateful_depths_after_a_restart_equal_batch(spark, tmp_path, k):
    _, reads = frames(spark)
    kmers = target_kmers(spark, k)
    reads = reads.withColumn("sample", F.when(F.col("sample") == "s1", F.col("sample")))  # a null sample too
    src = str(tmp_path / "reads")
    for part in range(2):
        reads.filter(F.col("seq_id") % 2 == part).repartition(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(src)
        got = step(depths.depth_updates(stream, kmers, k, S, shards=3), tmp_path)
    want = by_kmer(Q.abundance(reads, kmers, k, S))
    assert by_kmer(got) == want and len(want) > 100
    assert got.filter("closed OR opened IS NOT NULL").count() == 0
    batches = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "rows").iterdir())
    assert batches == list(range(4))
    # a micro-batch that runs again replaces its rows
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    again = step(depths.depth_updates(stream, kmers, k, S, shards=3), tmp_path)
    assert by_kmer(again) == want


def test_stateful_depths_close_by_sample(spark, tmp_path):
    kmers = target_kmers(spark, K)
    src = str(tmp_path / "reads")
    batches = [[("a", "10:00:00", 0), ("b", "10:00:05", 1000)], [("b", "10:30:00", 1000)], [("b", "10:31:00", 2000)], [("a", "10:32:00", 0), ("b", "10:33:00", 0)], [("b", None, 0)]]
    for rows in batches:
        made = spark.createDataFrame([(n, t and f"2024-01-01 {t}", GENOME[i : i + 800]) for n, t, i in rows], "sample string, ts string, seq string").withColumn("ts", F.to_timestamp("ts"))
        made.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(made.schema).parquet(src)
        got = step(depths.depth_updates(stream, kmers, K, S, time="ts", idle_ms=600_000, shards=3), tmp_path)
    of_a = {(str(r["opened"])[11:], r["closed"], r["depth"]) for r in got.filter("sample = 'a'").collect()}
    assert of_a == {("10:00:00", True, 1), ("10:32:00", False, 1)}
    b = got.filter("sample = 'b'")
    assert {str(r["opened"])[11:] for r in b.collect()} >= {"10:00:05"}
    whole = spark.read.parquet(src).filter("sample = 'b'")
    total = b.groupBy("sample", "kmer").agg(F.sum("depth").alias("depth"))
    assert by_kmer(total) == by_kmer(Q.abundance(whole, kmers, K, S))


def test_counts_saturate_and_are_put_out_once():
    counts, changed = depths.added(None, pa.table({"kmer": [5, 6], "n": [MAX_DEPTH + 9, 2]}))
    assert dict(zip(*changed.to_pydict().values(), strict=True)) == {5: MAX_DEPTH, 6: 2}
    counts, changed = depths.added(counts, pa.table({"kmer": [5, 7, 5], "n": [1, 1, 1]}))
    assert changed.to_pydict() == {"kmer": [7], "depth": [1]} and len(counts) == 3


def test_the_stateful_query_deals_reads_by_the_tables_size(spark, tmp_path, monkeypatch):
    """Two micro-batches of as many files as Spark reads the table in; the batch counts."""
    from kmerlake.plans import files, tables

    d, before = "/root/testdata/sf0.001", spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(files, "folder", lambda spark: str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = files.stream_depths(spark, d)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(list((tmp_path / "reads").glob("*.parquet"))) > 4
    assert sorted(p.name for p in (tmp_path / "rows").iterdir()) == ["batch=0", "batch=1"]
    want = Q.abundance(tables.reads(spark, d), T.build(tables.targets(spark, d), files.K, files.S).kmers, files.K, files.S)
    assert by_kmer(got) == by_kmer(want.withColumn("kmer", dna.decode("kmer", files.K))) != {}
