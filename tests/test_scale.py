"""Large sides, large targets, long sequences: the ways taken at scale give the results of the plain ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerlake import api
from kmerlake.functions import dna
from kmerlake.operators import classify as C
from kmerlake.operators import containment as Q
from kmerlake.operators import kernel, prefilter, sides
from kmerlake.operators import targets as T
from kmerlake.operators.syncmers import syncmers, syncmers_native
from kmerlake.sources import shared
from tests.dna_data import fasta, random_dna, revcomp


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def scene(spark, k=31):
    base = [random_dna(1500, i) for i in range(4)]
    targets = spark.createDataFrame([(i, f"t{i}", q) for i, q in enumerate(base)], "target_idx long, target string, seq string")
    rng = random.Random(4)
    reads = []
    for i in range(60):
        q = rng.choice([*base, random_dna(1500, 100 + i)])
        a = rng.randrange(1200)
        reads.append((rng.choice("ab"), i, q[a : a + 300]))
    reads.append(("none", 1000, "ACGT"))
    return targets, spark.createDataFrame(reads, "sample string, seq_id long, seq string")


@pytest.mark.parametrize("k", [31, 61])
def test_filter_misses_none_and_passes_few(k):
    rng = np.random.default_rng(1)
    if k == 31:
        kmers = pa.array(rng.integers(0, 1 << 62, 20_000))
        others = pa.array(rng.integers(0, 1 << 62, 20_000))
    else:
        make = lambda: pa.Array.from_buffers(kernel.WIDE, 20_000, [None, pa.py_buffer(rng.integers(0, 1 << 58, (20_000, 2)).astype(np.uint64))])
        kmers, others = make(), make()
    blocks = 20_000 * prefilter.BITS // 256 + 1
    table = np.zeros((blocks, prefilter.WORDS), np.uint32)
    np.bitwise_or.at(table, *prefilter._bits(prefilter.keys(kmers), blocks))
    assert prefilter.may_be_in(table, kmers).all() and prefilter.may_be_in(table, kmers.slice(7, 100)).all()
    assert prefilter.may_be_in(table, others).mean() < 0.02


def test_filter_is_built_in_segments(spark, monkeypatch):
    monkeypatch.setattr(prefilter, "SEGMENT_BLOCKS", 16)
    df = spark.range(5000).select((F.col("id") * 7919).alias("kmer"))
    table = prefilter.build(df, 5000).value
    assert prefilter.may_be_in(table, pa.array(np.arange(5000) * 7919)).all()
    assert prefilter.may_be_in(table, pa.array(np.arange(5000) * 7919 + 1)).mean() < 0.02


@pytest.mark.parametrize("k", [31, 45])
def test_large_sides_give_the_same_and_shuffle_hits_only(spark, monkeypatch, k):
    targets, reads = scene(spark)
    want = {}
    for limit in (sides.BROADCAST_ROWS, 0):
        monkeypatch.setattr(sides, "BROADCAST_ROWS", limit)
        t = T.build(targets, k, 9)
        index = C.group_index(targets.withColumn("group_idx", (F.col("target_idx") % 2).cast("int")), k, 9)
        names = spark.createDataFrame([(0, "g0"), (1, "g1")], "group_idx int, group string")
        got = {
            "depths": rows(Q.abundance(reads, t.kmers, k, 9)),
            "containment": rows(Q.containment(t, reads, k, 9, (2,), True).select("sample", "target", "containment1_hits", "containment2_hits", "median_nz_abundance", "sample_seqs", "sample_bases", "patchiness_z", "ani_est")),
            "reads": rows(C.per_sequence(reads, index, names, k, 9)),
            "background": rows(T.background_hits_of(t.kmers, reads, k, 9)),
        }
        want = want or got
        assert got == want
    # what passes the filter inside the generator is little more than what is there
    side = T.union_kmers(t.kmers)
    passed = syncmers(reads.select("seq"), k, 9, only=prefilter.build(side, side.count()))
    hits, every = passed.join(side, "kmer", "left_semi").count(), syncmers(reads.select("seq"), k, 9).count()
    assert 0 < hits <= passed.count() <= hits + 0.05 * (every - hits) + 5 and hits < every
    plan = passed.groupBy("kmer").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow")  # printed from the top: the filter runs below


def test_tallies_come_with_the_kmers(spark):
    _, reads = scene(spark)
    found = syncmers(reads, 31, 9, tally=True)
    sums = found.filter("kmer IS NULL").groupBy("sample").agg(F.sum("seqs"), F.sum("bases"), F.sum("mers"))
    n = syncmers(reads, 31, 9).groupBy("sample").agg(F.count("*").alias("n"))
    plain = reads.groupBy("sample").agg(F.count("*"), F.sum(F.length("seq"))).join(n, "sample", "left").na.fill(0)
    assert rows(sums) == rows(plain)
    empty = reads.filter("false")
    assert syncmers(empty, 31, 9, tally=True).count() == 0


def test_runs_over_borders(spark, monkeypatch):
    rng = random.Random(8)
    hits = [(t, i) for t in range(3) for i in range(1, 200) if rng.random() < 0.6]
    df = spark.createDataFrame(hits, "target_idx long, i long")
    monkeypatch.setattr(Q, "STRETCH_HITS", 7)
    got = {r["target_idx"]: (r["hits"], r["runs"], r["lo"], r["hi"]) for r in Q.run_counts(df, ["target_idx"]).collect()}
    for t in range(3):
        own = sorted(i for u, i in hits if u == t)
        assert got[t] == (len(own), 1 + sum(b - a > 1 for a, b in zip(own, own[1:], strict=False)), own[0], own[-1])


def test_once_numbers_go_on_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(Q, "STRETCH", 50)
    q = random_dna(2000, 3)
    tk = T.build(spark.createDataFrame([(5, "t", q + q[:200])], "target_idx long, target string, seq string"), 31, 9).kmers
    got = [tuple(r) for r in Q.numbered_once(tk).join(tk.select("kmer", "pos"), "kmer").orderBy("pos").select("i", "n").collect()]
    assert got == [(i + 1, len(got)) for i in range(len(got))] and len(got) > 40


def test_long_sequences_go_in_pieces(spark, monkeypatch):
    q = random_dna(5000, 1) + "N" + "é" + random_dna(5000, 2)
    whole = list(kernel.blocks(pa.array([q, "ACGT", q]), 31))
    monkeypatch.setattr(kernel, "BLOCK_BASES", 700)
    cut = list(kernel.blocks(pa.array([q, "ACGT", q]), 31))
    found = lambda blocks: sorted((row + int(np.searchsorted(at, p, "right")) - 1, p - at[np.searchsorted(at, p, "right") - 1] + shift) for row, code, at, shift in blocks for p in kernel.select(code, at, 31, 9, "md5").tolist())
    assert found(cut) == found(whole) and len(cut) > 25 and max(len(c) for _, c, _, _ in cut) <= 730


def test_wide_kmers_decode(spark):
    for k in (33, 61):
        df = spark.createDataFrame([(1, random_dna(1500, k)), (2, revcomp(random_dna(1500, k)))], "id long, seq string")
        wide = syncmers(df, k, 9)
        assert dict(wide.dtypes)["kmer"] == "decimal(38,0)"
        assert rows(wide.select("id", dna.decode("kmer", k).alias("kmer"))) == rows(syncmers(df, k, 9, text=True))
        assert wide.filter("id = 1").select("kmer").exceptAll(wide.filter("id = 2").select("kmer")).count() == 0


@pytest.mark.parametrize("s", [5, 9, 15, 31])
def test_rolling_order(spark, s):
    k, q = 45, random_dna(20_000, s)
    one = lambda x: syncmers(spark.createDataFrame([(1, x)], "id long, seq string"), k, s, positions=True, order="rolling", text=True)
    ahead, back = one(q), one(revcomp(q))
    assert sorted((len(q) - k - r["pos"], r["kmer"]) for r in back.collect()) == sorted((r["pos"], r["kmer"]) for r in ahead.collect())
    assert 0.8 < ahead.count() / (len(q) / (k - s + 1)) < (1.3 if s > 5 else 2)
    if s < 12:
        assert rows(syncmers_native(spark.createDataFrame([(1, q[:500])], "id long, seq string"), k, s, order="rolling")) == rows(one(q[:500]))


def test_an_analysis_of_files_reads_them_once(spark, tmp_path, monkeypatch):
    (tmp_path / "t.fa").write_text(fasta([(f"t{i}", random_dna(900, i)) for i in range(3)]))
    (tmp_path / "r.fa").write_text(fasta([(f"r{i}", random_dna(900, i % 3)[100:400]) for i in range(30)]))
    ran = []
    inner = shared.keep
    monkeypatch.setattr(shared, "keep", lambda df, name, *a, **b: ran.append(df._jdf.queryExecution().executedPlan().toString()) or inner(df, name, *a, **b))
    out = api.query(spark, str(tmp_path / "t.fa"), [str(tmp_path / "r.fa")], individual=True, confidence=True, totals=True, sort="target", limit="1M")
    assert [r["target"] for r in out.collect()] == ["t0", "t1", "t2", "TOTAL"]
    generators = sum(p.count("MapInArrow") for p in ran) + out._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert generators == 2, "targets and reads"


def test_figures_are_noted_without_more_jobs(spark, tmp_path):
    (tmp_path / "t.fa").write_text(fasta([(f"t{i}", random_dna(900, i)) for i in range(3)]))
    (tmp_path / "r.fa").write_text(fasta([(f"r{i}", random_dna(900, i % 3)[100:400]) for i in range(30)]))
    t, r = str(tmp_path / "t.fa"), str(tmp_path / "r.fa")
    jobs, notes = [], {}
    for given in (None, notes):
        spark.sparkContext.setJobGroup(f"noted {given is None}", "")
        api.query(spark, t, [r], individual=True, notes=given).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"noted {given is None}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] > 0
    tk, _, _, _ = api.load_targets(spark, t, individual=True)
    depths = Q.abundance(api._reads(spark, [r], None, None), tk.kmers, 31, 9)
    assert notes == {"target_records": 3, "target_bases": 2700, "target_kmers_selected": tk.kmers.count(), "reads": 30, "read_bases": 9000, "kmers_found": depths.count(), "kmer_hits": depths.agg(F.sum("depth")).first()[0]}


def test_kept_tables_can_be_released(spark):
    import os
    from urllib.parse import urlparse

    df = shared.keep(spark.range(10), "x")
    path = urlparse(df.inputFiles()[0]).path
    assert os.path.exists(path)
    shared.release(spark)
    assert not os.path.exists(path)


def test_files_follow_the_table(spark, monkeypatch):
    """No file, and so no task, grows with the documents."""
    from kmerlake.plans import files
    from kmerlake.sources import paths

    monkeypatch.setattr(files, "folder", lambda spark, inner=files.folder: inner(spark).removeprefix("file://"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        folders = files._read_files(spark, "/root/testdata/sf0.001", [".fq", ".fa"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(len(paths.fastx_files(f)) > 6 for f in folders.values())
