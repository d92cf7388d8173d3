import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerlake.functions import dna
from kmerlake.operators import kernel
from kmerlake.operators.syncmers import split_long, syncmers, syncmers_native
from tests.dna_data import random_dna, revcomp


def brute(seq, k, s):
    half, out = (k - s) // 2, []

    def h(m):
        c = min(m, revcomp(m))
        return int(hashlib.md5(c.encode()).hexdigest()[:15], 16)

    for p in range(len(seq) - k + 1):
        kmer = seq[p : p + k]
        if set(kmer) <= set("ACGT"):
            hs = [h(kmer[i : i + s]) for i in range(k - s + 1)]
            if hs[half] == min(hs):
                out.append((p, min(kmer, revcomp(kmer))))
    return out


def found(spark, seqs, k, s, **how):
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    return sorted((r["id"], r["pos"], r["kmer"]) for r in syncmers(df, k, s, positions=True, text=True, **how).collect())


SEQS = ["", "ACGT", "ACGTACGTACGT", "ACGTACGTACGTACGT", random_dna(400, 3), random_dna(120, 5) + "N" + random_dna(150, 9), random_dna(90, 1).lower() + "ACGTTGCATGCCGATA" * 4, "é" * 5 + random_dna(80, 8), None]


@pytest.mark.parametrize(("k", "s"), [(5, 3), (7, 3), (15, 7), (31, 9), (33, 9), (61, 5)])
def test_kernel_and_dataframe_form_equal_brute_force(spark, k, s):
    want = sorted((i, p, m) for i, q in enumerate(SEQS) for p, m in brute(q or "", k, s))
    assert found(spark, SEQS, k, s) == want
    df = spark.createDataFrame(list(enumerate(SEQS)), "id long, seq string")
    assert sorted((r["id"], r["pos"], r["kmer"]) for r in syncmers_native(df, k, s).collect()) == want


def test_packed_equals_text(spark):
    df = spark.createDataFrame([(1, random_dna(2000, 4))], "id long, seq string")
    packed = syncmers(df, 31, 9, positions=True).select("pos", dna.decode("kmer", 31).alias("kmer"))
    text = syncmers(df, 31, 9, positions=True, text=True).select("pos", "kmer")
    assert packed.exceptAll(text).count() == 0 and packed.count() == text.count() > 40


@pytest.mark.parametrize("order", ["md5", "mix", "lex"])
def test_strands_agree(spark, order):
    seq, k = random_dna(3000, 11), 31
    a = found(spark, [seq], k, 9, order=order)
    b = found(spark, [revcomp(seq)], k, 9, order=order)
    assert sorted((len(seq) - k - p, m) for _, p, m in b) == sorted((p, m) for _, p, m in a)


@pytest.mark.parametrize("s", [11, 15, 17, 31])
def test_long_smers(spark, s):
    seq = random_dna(4000, 21)
    a, b = found(spark, [seq], 61, s), found(spark, [revcomp(seq)], 61, s)
    assert a and sorted(m for _, _, m in a) == sorted(m for _, _, m in b)
    with pytest.raises(Exception, match="md5 order"):
        found(spark, [seq], 61, s, order="md5")


def test_blocks_do_not_matter(spark, monkeypatch):
    want = found(spark, SEQS, 15, 7)
    df = spark.createDataFrame(list(enumerate(SEQS)), "id long, seq string")
    pieces = split_long(df, 15, 40)
    got = syncmers(pieces, 15, 7, positions=True, text=True).select("id", F.col("chunk_start") + F.col("pos"), "kmer").collect()
    assert sorted(map(tuple, got)) == want


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ACGTN", max_size=120))
def test_kernel_property(seq):
    import numpy as np
    import pyarrow as pa

    got = []
    for _, code, at, _ in kernel.blocks(pa.array([seq])):
        starts = kernel.select(code, at, 9, 5, "md5")
        got += list(zip(starts.tolist(), kernel.spelled(code, np.asarray(starts), 9).to_pylist(), strict=True))
    assert got == brute(seq, 9, 5)


def test_fracminhash(spark):
    df = spark.createDataFrame([(random_dna(200_000, 42),)], "seq string")
    kmers = syncmers(df, 31, 9, text=True).distinct()
    n = kmers.count()
    kept = kmers.filter(dna.sketched(F.col("kmer"), 0.1))
    assert abs(kept.count() / n - 0.1) < 0.03
    assert kmers.filter(dna.sketched(F.col("kmer"), 1.0)).count() == n
    assert kept.exceptAll(kmers.filter(dna.sketched(F.col("kmer"), 0.2))).count() == 0
