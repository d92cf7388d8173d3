"""Masks of groups, the binary form and bucketed indexes."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerlake.operators import classify as C
from kmerlake.operators import kernel, masks, sides
from kmerlake.operators import targets as T
from kmerlake.operators.syncmers import syncmers
from kmerlake.sources import index, packed
from tests.dna_data import random_dna


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_masks_of_128_groups_are_the_rows(spark):
    rng = random.Random(1)
    pairs = {(rng.randrange(60), g) for g in range(128) for _ in range(3)} | {(100, g) for g in range(128)} | {(101, 63), (102, 127), (103, 64)}
    df = spark.createDataFrame(list(pairs) * 2, "kmer long, group_idx int")
    m = masks.from_rows(df)
    assert m.count() == len({k for k, _ in pairs}) and rows(masks.to_rows(m)) == sorted(pairs)
    assert rows(masks.unique(m).select("kmer")) == sorted((k,) for k in {k for k, _ in pairs} if sum(x == k for x, _ in pairs) == 1)
    assert rows(masks.to_rows(C.discriminatory(m))) == rows(C.discriminatory(df.distinct()))


def test_reads_by_masks_and_by_rows_are_alike(spark):
    groups = spark.createDataFrame([(g, random_dna(400, g % 3) + random_dna(300, 50 + g)) for g in (0, 63, 64, 127)], "group_idx int, seq string")
    names = spark.createDataFrame([(g, f"g{g}") for g in (0, 63, 64, 127)], "group_idx int, group string")
    reads = spark.createDataFrame([("s", i, random_dna(400, i % 4)[50:350] if i % 5 else random_dna(300, 50 + 63)) for i in range(20)], "sample string, seq_id long, seq string")
    by_rows = C.per_sequence(reads, C.group_index(groups, 31, 9), names, 31, 9)
    m = C.mask_index(groups, 31, 9)
    assert rows(by_rows) == rows(C.per_sequence(reads, m, names, 31, 9)) == rows(C.per_sequence(reads, m, names, 31, 9, n_kmers=m.count()))


@pytest.mark.parametrize("k", [5, 15, 31, 33, 61])
def test_entries_keep_kmers_and_their_order(k):
    rng = np.random.default_rng(k)
    code = rng.integers(0, 4, 5000).astype(np.uint8)
    starts = np.arange(5000 - k)
    kmers = pa.array(kernel.packed(code, starts, k)) if k <= 31 else kernel.packed_wide(code, starts, k)
    got = packed._to_bytes(kmers, k)
    assert got.dtype.itemsize == -(-k // 4) and packed._from_bytes(got, k).equals(kmers)
    by_bytes = [kmers[i].as_py() for i in sorted(range(len(got)), key=lambda i: got[i].tobytes())]
    assert by_bytes == sorted(kmers.to_pylist())


@pytest.mark.parametrize("k", [31, 45])
def test_packed_round_trip_in_stretches(spark, tmp_path, monkeypatch, k):
    targets = spark.createDataFrame([(i, f"t{i}", random_dna(3000, i)) for i in range(4)], "target_idx long, target string, seq string")
    t = T.build(targets, k, 9)
    index.save_query_index(spark, f"file://{tmp_path}/x", t, k, 9, positions=True, form="packed")
    back, meta = index.load_targets(spark, f"file://{tmp_path}/x", need_positions=True)
    assert rows(back.kmers) == rows(t.kmers) and (meta["form"], meta["n_kmers"]) == ("packed", t.kmers.count())
    assert not [n for n in os.listdir(tmp_path / "x/kmers") if n.startswith(".") and not n.endswith(".crc")]
    size = sum(p.stat().st_size for p in (tmp_path / "x/kmers").glob("*.kmers"))
    assert size <= meta["n_kmers"] * (-(-k // 4) + 16) + 8 * 50
    monkeypatch.setattr(packed, "SPLIT", 700)
    found = packed.manifest(f"{tmp_path}/x/kmers")
    reader = packed.PackReader(f"{tmp_path}/x/kmers", found, spark.read.format("kmerpack").load(f"{tmp_path}/x/kmers").schema)
    parts = reader.partitions()
    assert len(parts) > 5 and sum(p.n for p in parts) == meta["n_kmers"]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == meta["n_kmers"]


def test_wrong_kind_cut_and_foreign_files(spark, tmp_path):
    groups = spark.createDataFrame([(0, random_dna(500, 1)), (1, random_dna(500, 2))], "group_idx int, seq string")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "group_idx int, group string")
    index.save_classify_index(spark, f"{tmp_path}/c", C.mask_index(groups, 31, 9), names, 31, 9, form="packed")
    assert index.load(spark, f"{tmp_path}/c", index.CLASSIFY).kmers.count() > 0
    with pytest.raises(ValueError, match="is a classify index, not a query index"):
        index.load(spark, f"{tmp_path}/c", index.QUERY)
    part = next((tmp_path / "c/kmers").glob("*.kmers"))
    data = part.read_bytes()
    part.write_bytes(data[:-3])
    with pytest.raises(Exception, match="Truncated index"):
        index.load(spark, f"{tmp_path}/c", index.CLASSIFY).kmers.count()
    part.write_bytes(b"SOMEELSE" + data[8:])
    with pytest.raises(Exception, match="Not a k-mer table"):
        index.load(spark, f"{tmp_path}/c", index.CLASSIFY).kmers.count()
    with pytest.raises(ValueError, match="Not a k-mer table"):
        packed.manifest(str(tmp_path))
    with pytest.raises(Exception, match="exists already"):
        packed.write(C.mask_index(groups, 31, 9), f"{tmp_path}/c/kmers", 31)
    with pytest.raises(Exception, match="int or long"):
        packed.write(groups.withColumn("kmer", F.lit(1)).select("kmer", "seq"), f"{tmp_path}/d", 31)


def test_a_failed_write_leaves_no_table(spark, tmp_path):
    bad = spark.range(100).select((F.col("id") + F.raise_error(F.lit("stop")).cast("long")).alias("kmer"), F.lit(1).alias("group_idx"))
    with pytest.raises(Exception, match="stop"):
        packed.write(bad, f"{tmp_path}/x", 31)
    assert not (tmp_path / "x" / packed.MANIFEST).exists()


def test_empty_table(spark, tmp_path):
    packed.write(spark.createDataFrame([], "kmer long, lo long, hi long"), f"{tmp_path}/x", 31)
    assert packed.read(spark, f"{tmp_path}/x").count() == 0


def test_buckets_spare_the_index_its_exchange(spark, tmp_path, monkeypatch):
    groups = spark.createDataFrame([(g, random_dna(3000, g)) for g in range(3)], "group_idx int, seq string")
    names = spark.createDataFrame([(g, f"g{g}") for g in range(3)], "group_idx int, group string")
    reads = spark.createDataFrame([("s", i, random_dna(3000, i % 3)[i * 10 : i * 10 + 300]) for i in range(30)], "sample string, seq_id long, seq string")
    index.save_classify_index(spark, f"file://{tmp_path}/b", C.mask_index(groups, 31, 9), names, 31, 9, form="buckets", buckets=6)
    spark.sql(f"DROP TABLE {index._table(f'file://{tmp_path}/b')}")  # as another session finds it
    found = index.load(spark, f"file://{tmp_path}/b", index.CLASSIFY)
    monkeypatch.setattr(sides, "BROADCAST_ROWS", 0)
    got = C.per_sequence(reads, found.kmers, found.names, 31, 9, n_kmers=found.meta["n_kmers"])
    plain = C.per_sequence(reads, C.group_index(groups, 31, 9), names, 31, 9)
    assert rows(got) == rows(plain)
    joined = syncmers(reads.select("seq_id", "seq"), 31, 9).join(found.kmers.hint("shuffle_hash"), "kmer")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
