import random
from collections import defaultdict

import numpy as np

from kmerlake.llm import line_dedup
from kmerlake.llm.cuckoo import CuckooFilter
from tests.llm.fixtures import corpus, empty, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def brute(rows):
    docs = defaultdict(set)
    for d, t, *_ in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    docs[key(line)].add(d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (len(docs[key(x)]) > 1 and d > min(docs[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def shared(rows):
    return rows + [(7000 + i, f"A line that every one of these holds\nown line number {i} here\n  a LINE that every one of these holds\t", "en", "s", 0) for i in range(40)]


def result(docs, index=None):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs, index).collect()), key=str)


def test_equals_brute_force(spark):
    rows = shared(corpus())
    assert result(frame(spark, rows)) == brute(rows)


def test_many_shards_and_chunks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK_POSTINGS", 9)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    rows = shared(corpus(60))
    assert result(frame(spark, rows)) == brute(rows)


def test_insertions_and_deletions_are_reversible(spark):
    rows = shared(corpus(60))
    first, more = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    more = [r for r in more if r[0] is None or r[0] not in {x[0] for x in first}]
    index = line_dedup.build_index(frame(spark, first))
    both = line_dedup.insert_documents(index, frame(spark, more))
    assert result(frame(spark, first + more), both) == brute(first + more)
    ids = spark.createDataFrame([(r[0],) for r in more if r[0] is not None], "doc_id long")
    back = line_dedup.delete_documents(both, ids)
    assert result(frame(spark, first), back) == brute(first)
    owner = spark.createDataFrame([(7000,)], "doc_id long")
    less = line_dedup.delete_documents(both, owner)
    rest = [r for r in first + more if r[0] != 7000]
    assert result(frame(spark, rest), less) == brute(rest)


def test_empty(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_clashing_columns_pass_through(spark):
    docs = frame(spark).selectExpr("*", "1 AS n_lines", "'x' AS key", "2 AS owner")
    assert line_dedup.dedup_lines(docs).count() == docs.count()


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    f = CuckooFilter.from_bytes(CuckooFilter.of(keys).to_bytes())
    assert f.contains(keys).all()
    others = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert f.contains(others).mean() < 0.002
    for k in keys[:1000]:
        assert f.delete(k)
    assert f.contains(keys[1000:]).all() and f.contains(keys[:1000]).mean() < 0.01


def test_insertion_into_an_index_without_shared_lines(spark):
    first = [(1, "a line of its own\nand one that will be shared", "en", "s", 0), (2, "nothing in common", "en", "s", 0)]
    more = [(3, "And one that will be shared\nbut not this", "en", "s", 0)]
    index = line_dedup.insert_documents(line_dedup.build_index(frame(spark, first)), frame(spark, more))
    assert result(frame(spark, first + more), index) == brute(first + more)
    index = line_dedup.insert_documents(line_dedup.build_index(empty(spark)), frame(spark, first + more))
    assert result(frame(spark, first + more), index) == brute(first + more)


def test_full_filters_are_built_anew(spark, monkeypatch):
    first = [(i, f"line {i} that two will hold, or more\nline {i % 2} of the first ones", "en", "s", 0) for i in range(300)]
    more = [(1000 + i, f"line {i} that two will hold, or more", "en", "s", 0) for i in range(300)]
    for keys in (40_000, 20):  # one shard that runs full; many more shards
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", keys)
        index = line_dedup.insert_documents(line_dedup.build_index(frame(spark, first)), frame(spark, more))
        assert result(frame(spark, first + more), index) == brute(first + more)
        assert index.filters.select("n_shards").first()[0] == (1 if keys == 40_000 else 16)


def test_random_sequences_equal_a_fresh_build(spark):
    rng = random.Random(5)
    pool = [(i, "\n".join(f"a line number {rng.randrange(25)}" for _ in range(rng.randrange(4))), "en", "s", 0) for i in range(60)]
    held, index = [], line_dedup.build_index(empty(spark))
    for _ in range(3):
        new = [r for r in rng.sample(pool, 20) if r not in held]
        index, held = line_dedup.insert_documents(index, frame(spark, new)), held + new
        out = rng.sample(held, len(held) // 3)
        index, held = line_dedup.delete_documents(index, spark.createDataFrame([(r[0],) for r in out], "doc_id long")), [r for r in held if r not in out]
        fresh = line_dedup.build_index(frame(spark, held))
        assert sorted(index.references.collect()) == sorted(fresh.references.collect())
    assert result(frame(spark, held), index) == brute(held)


def test_lines_that_share_a_hash_stay_in_the_filter(spark, monkeypatch):
    """Only three hashes for all keys: a hash leaves its filter with the last shared key that has it."""
    from pyspark.sql import functions as F

    inner = line_dedup.postings
    monkeypatch.setattr(line_dedup, "postings", lambda docs: inner(docs).withColumn("hash", F.pmod("hash", F.lit(3))))
    rng = random.Random(6)
    pool = [(i, "\n".join(f"a line number {rng.randrange(12)}" for _ in range(rng.randrange(4))), "en", "s", 0) for i in range(40)]
    held, index = [], line_dedup.build_index(empty(spark))
    for _ in range(3):
        new = [r for r in rng.sample(pool, 14) if r not in held]
        index, held = line_dedup.insert_documents(index, frame(spark, new)), held + new
        assert result(frame(spark, held), index) == brute(held)
        out = rng.sample(held, len(held) // 2)
        index, held = line_dedup.delete_documents(index, spark.createDataFrame([(r[0],) for r in out], "doc_id long")), [r for r in held if r not in out]
        assert result(frame(spark, held), index) == brute(held)
