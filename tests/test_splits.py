"""Ranges of files: the same records and numbers as the whole, whatever the cuts; limits that read no more than they need."""

import gzip
import io
import json
import os
import random
from dataclasses import asdict

import pyarrow as pa
import pytest
from pyspark.cloudpickle import dumps

from kmerlake.sources import fastx, splits
from tests.dna_data import random_dna

ENDINGS = (".fa", ".fq", ".fa.gz", ".fq.gz", ".fa.zst", ".fq.zst")


def sequences(n, seed):
    rng = random.Random(seed)
    return [(f"read {i} @>+", random_dna(rng.choice([0, 1, 30, 90, 400, 3000]), seed + i)) for i in range(n)]


def text_of(rows, fastq, rng, wrap=0):
    if not fastq:
        lines = lambda s: "\n".join(s[i : i + wrap] for i in range(0, len(s), wrap)) if wrap else s
        return "".join(f">{n}\n{lines(s)}\n" for n, s in rows)
    # qualities that look like headers and like separators
    quality = lambda s: "".join(rng.choice("@+>I5") for _ in s)
    return "".join(f"@{n}\n{s}\n+\n{quality(s)}\n" for n, s in rows)


def write(path, text, block=3000):
    data = text.encode()
    if path.endswith(".gz"):
        with open(path, "wb") as raw, fastx._Blocks(raw, block, fastx._bgzf_block, fastx._bgzf_block(b"")) as out:
            out.write(data)
    elif path.endswith(".zst"):
        with open(path, "wb") as raw, fastx._Blocks(raw, block, lambda x: pa.compress(x, codec="zstd", asbytes=True)) as out:
            out.write(data)
    else:
        open(path, "wb").write(data)


@pytest.mark.parametrize("ending", ENDINGS)
def test_ranges_give_the_records_and_numbers_of_the_whole_file(spark, tmp_path, ending):
    rng, path = random.Random(3), str(tmp_path / f"reads{ending}")
    rows = sequences(400, 11)
    write(path, text_of(rows, ".fq" in ending, rng))
    for size in (3001, 20_011):
        planned = splits.plan(spark, [("s", 0, path)], size)
        assert len(planned) > 3, (ending, size)
        got = fastx.read_fastx(spark, [("s", 0, path)], split=size)
        assert got.rdd.getNumPartitions() == len(planned)
        assert sorted((r["rec_idx"], r["seq_id"], r["seq"]) for r in got.collect()) == [(i, *r) for i, r in enumerate(rows)]
    loose = fastx.read_fastx(spark, [("s", 0, path)], numbers=False, split=5000).orderBy("rec_idx").collect()
    assert [(r["seq_id"], r["seq"]) for r in loose] == rows


@pytest.mark.parametrize("ending", [".fq", ".gz", ".xz"])
def test_files_without_places_to_cut_are_one_range(spark, tmp_path, ending):
    path, rows = str(tmp_path / f"one{ending}"), sequences(60, 5)
    if ending == ".fq":  # sequences and qualities over several lines
        text = "".join(f"@{n}\n{s[:7]}\n{s[7:]}\n+\n{'I' * len(s[:7])}\n{'I' * len(s[7:])}\n" for n, s in rows if len(s) > 30)
        rows = [r for r in rows if len(r[1]) > 30]
        write(path, text)
    elif ending == ".gz":
        open(path, "wb").write(gzip.compress(text_of(rows, False, None).encode()))
    else:
        import lzma

        open(path, "wb").write(lzma.compress(text_of(rows, False, None).encode()))
    assert len(splits.plan(spark, [("s", 0, path)], 500)) == 1
    got = fastx.read_fastx(spark, [("s", 0, path)], split=500).collect()
    assert [(r["rec_idx"], r["seq_id"], r["seq"]) for r in got] == [(i, *r) for i, r in enumerate(rows)]


def test_wrapped_fasta_line_ends_and_records_longer_than_ranges(spark, tmp_path):
    path, rows = str(tmp_path / "w.fa"), [("a", random_dna(9000, 1)), ("b", ""), ("c", random_dna(50, 2)), ("d", random_dna(5000, 3))]
    open(path, "wb").write(text_of(rows, False, None, wrap=60).replace("\n", "\r\n").encode())
    got = fastx.read_fastx(spark, [("s", 0, path)], split=1000).collect()
    assert sorted((r["rec_idx"], r["seq_id"], r["seq"]) for r in got) == [(i, *r) for i, r in enumerate(rows)]


def test_starts_are_proved():
    tricky = b"II\n@II\n@r1\nACGT\n+\n@+@+\n@r2\nAC\n+\n++\n"
    assert splits.record_start(tricky, False, True) == tricky.index(b"@r1")
    assert splits.record_start(tricky[:20], False, False) is None
    assert splits.record_start(b"AC\nGT\n>x\nA", True, False) == 6
    assert splits.record_start(b"no line", True, True) is None


def test_block_starts_inside_data_are_not_taken(tmp_path):
    """A zstd frame's magic inside a stored block."""
    path = str(tmp_path / "x.zst")
    frame = pa.compress(os.urandom(50) + splits._ZSTD_MAGIC + os.urandom(50), codec="zstd", asbytes=True)
    open(path, "wb").write(frame * 3)
    assert splits._next_block(path, splits.ZSTD, 1, 3 * len(frame), 3 * len(frame)) == len(frame)
    assert splits.kind_of(gzip.compress(b"x")) == splits.GZIP and splits.kind_of(fastx._bgzf_block(b"x")) == splits.BGZF
    assert gzip.GzipFile(fileobj=io.BytesIO(fastx._bgzf_block(b"ab") + fastx._bgzf_block(b""))).read() == b"ab"


@pytest.mark.parametrize("ending", [".fq", ".fa.gz"])
@pytest.mark.parametrize("limit", [0, 5000, 10**9])
def test_limits_end_at_the_exact_record(spark, tmp_path, ending, limit):
    rng, files = random.Random(1), []
    for i in range(3):
        files.append(("a" if i < 2 else "b", i % 2, str(tmp_path / f"{i}{ending}")))
        write(files[-1][2], text_of(sequences(60, 10 * i + 1), ".fq" in ending, rng))
    expected = []
    for sample in "ab":
        before = 0
        for _, i, path in (f for f in files if f[0] == sample):
            for j, (name, seq) in enumerate(sequences(60, 10 * files.index((sample, i, path)) + 1)):
                if before < limit:
                    expected.append((sample, i, j, name, seq))
                before += len(seq)
    got = fastx.read_fastx(spark, files, limit=limit, split=4000).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_what_a_limit_reads_follows_the_limit(spark, tmp_path):
    path = str(tmp_path / "long.fa")
    write(path, "".join(f">{i}\n{random_dna(1000, i)}\n" for i in range(1500)))
    ranges = splits.plan(spark, [("s", 0, path)], 20_000)
    counted = []
    inner = splits._sizes
    splits._sizes = lambda s, r, n: counted.extend(r) or inner(s, r, n)
    try:
        kept = splits.limited(spark, ranges, 50_000)
    finally:
        splits._sizes = inner
    spans = [r.end_block - r.block for r in counted]
    assert len(ranges) > 70 and len(kept) <= 4 and sum(spans) < 4 * 50_000 + 40_000, (len(kept), sum(spans))


def test_tasks_get_no_plan():
    """What a task unpickles stays as it is, however many ranges there are."""

    def sizes(n):
        source = fastx.FastxSource({"ranges": json.dumps([asdict(splits.Range("s", 0, "/x", block=i)) for i in range(n)])})
        reader = source.reader(None)
        assert len(reader.partitions()) == n
        return len(dumps((source, reader)))

    assert sizes(2000) == sizes(2)


def test_ranges_grow_where_there_would_be_too_many(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "reads.fa"), sequences(900, 4)
    write(path, text_of(rows, False, None))
    many = splits.plan(spark, [("s", 0, path)], 2000)
    monkeypatch.setattr(splits, "RANGES", 40)
    few = splits.plan(spark, [("s", 0, path)], 2000)
    assert len(many) > 100 and 20 < len(few) <= 41
    got = fastx.read_fastx(spark, [("s", 0, path)], split=2000).collect()
    assert sorted((r["rec_idx"], r["seq_id"], r["seq"]) for r in got) == [(i, *r) for i, r in enumerate(rows)]


def test_several_formats_in_one_pass_and_numbers_through_files(spark, tmp_path):
    rows = [(f"r{i}", (random_dna(300, i), "Ac\n-é*😀.1", "", None)[i % 4]) for i in range(200)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, seq_id string, seq string")
    folders = {e: str(tmp_path / e[1:]) for e in (".fa", ".fq.gz", ".fa.zst", ".fq.xz")}
    fastx.write_formats(df.repartitionByRange(3, "i").sortWithinPartitions("i").select("seq_id", "seq"), folders)
    want = [(i, n, (s or "").replace("Ac\n-é*😀.1", "AcN-N*N.N")) for i, (n, s) in enumerate(rows)]
    read = fastx.read_samples(spark, list(folders.values()), list(folders), split=4000, through=True)
    got = read.collect()
    assert len({r["file_idx"] for r in got}) == 3
    for e in folders:
        assert sorted((r["rec_idx"], r["seq_id"], r["seq"]) for r in got if r["sample"] == e) == want, e


def test_files_behind_a_limit_are_not_opened(spark, tmp_path):
    files = []
    for i in range(7):
        files.append(("a" if i < 6 else "b", i % 6, str(tmp_path / f"{i}.fq")))
        write(files[-1][2], text_of(sequences(40, 10 * i + 1), True, random.Random(i)))
    for _, _, path in files[3:6]:
        open(path, "wb").write(b"no sequence file " * 1000)
    bases = [sum(len(s) for _, s in sequences(40, 10 * i + 1)) for i in range(7)]
    got = fastx.read_fastx(spark, files, limit=bases[0] + bases[1] + 5, split=4000).collect()
    of = lambda s: sorted((r["file_idx"], r["rec_idx"], r["seq"]) for r in got if r["sample"] == s)
    want = [(i, j, s) for i in range(3) for j, (_, s) in enumerate(sequences(40, 10 * i + 1))]
    before = [sum(len(s) for *_, s in want[:n]) for n in range(len(want))]
    assert of("a") == [w for w, n in zip(want, before, strict=True) if n < bases[0] + bases[1] + 5]
    assert of("b") == [(0, j, s) for j, (_, s) in enumerate(sequences(40, 61))]
