import gzip
import lzma
import os
import threading
from types import SimpleNamespace

import pyarrow as pa
import pytest

from kmerlake.sources import fastx, paths, storage
from tests.dna_data import fasta, fastq, random_dna

RECORDS = [("a first", random_dna(70, 1)), ("b", ""), ("c\tx", random_dna(300, 2))]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "one.fa").write_text(fasta(RECORDS))
    (tmp_path / "two.fastq.gz").write_bytes(gzip.compress(fastq(RECORDS).encode()))
    (tmp_path / "three.fq.xz").write_bytes(lzma.compress(fastq(RECORDS).encode()))
    with pa.CompressedOutputStream(pa.OSFile(str(tmp_path / "four.fasta.zst"), "wb"), "zstd") as out:
        out.write(fasta(RECORDS).encode())
    (tmp_path / "README.txt").write_text("no sequences")
    (tmp_path / ".hidden.fa").write_text(fasta(RECORDS))
    return tmp_path


def test_formats(spark, folder):
    got = fastx.read_samples(spark, [str(folder)]).collect()
    files = sorted(n for n in os.listdir(folder) if paths.is_fastx(n) and not n.startswith("."))
    assert sorted((r["file_idx"], r["rec_idx"], r["seq_id"], r["seq"]) for r in got) == [(i, j, *r) for i in range(len(files)) for j, r in enumerate(RECORDS)]
    assert {r["sample"] for r in got} == {folder.name}


def test_wrapped_lines_and_errors(spark, tmp_path):
    (tmp_path / "w.fa").write_text("\n>x y\r\nACGT\r\nAC\n\n>z\nGG")
    assert [(r["seq_id"], r["seq"]) for r in fastx.read_samples(spark, [str(tmp_path / "w.fa")]).collect()] == [("x y", "ACGTAC"), ("z", "GG")]
    for bad in ("no record", "@a\nACGT\n", "@a\nACGT\n+\nII"):
        (tmp_path / "bad.fq").write_text(bad)
        with pytest.raises(Exception, match="FASTQ|FASTA"):
            fastx.read_samples(spark, [str(tmp_path / "bad.fq")]).collect()
    (tmp_path / "none.fa").write_text("")
    assert fastx.read_samples(spark, [str(tmp_path / "none.fa")]).count() == 0


def test_pipe_is_copied_to_the_shared_folder(spark, tmp_path, monkeypatch):
    pipe, shared = tmp_path / "p.fa", tmp_path / "shared"
    os.mkfifo(pipe)
    writer = threading.Thread(target=lambda: pipe.write_text(">r\nACGT\n"))
    writer.start()
    monkeypatch.setattr(fastx, "_spool_folder", lambda spark: str(shared))
    assert [r["seq"] for r in fastx.read_fastx(spark, [("s", 0, str(pipe))]).collect()] == ["ACGT"]
    writer.join()
    assert len(list(shared.iterdir())) == 1


def test_spool_folder_follows_the_session():
    folder = lambda x: fastx._spool_folder(SimpleNamespace(conf={"spark.checkpoint.dir": x}))
    assert [folder(x) for x in (None, "/mnt/x", "file:///mnt/x", "hdfs://n/x")] == [None, "/mnt/x", "/mnt/x", "hdfs://n/x"]


def test_pipe(spark, tmp_path):
    pipe = str(tmp_path / "pipe")
    os.mkfifo(pipe)
    assert paths.is_special(pipe) and paths.is_special("/dev/fd/63") and not paths.is_special(str(tmp_path))
    writer = threading.Thread(target=lambda: open(pipe, "w").write(fastq(RECORDS)))
    writer.start()
    assert fastx.read_samples(spark, [pipe]).count() == len(RECORDS)
    writer.join()


def test_names():
    for path, want in (("/x/a.fa", "a"), ("b.fastq.gz", "b"), ("c.FA", "c.FA"), ("d.fa.fa.zst", "d"), (".fa", ".fa"), ("-", "stdin")):
        assert paths.sample_name(path) == want
    assert paths.is_fastx("X.FASTQ.GZ") and not paths.is_fastx("x.txt") and not paths.is_fastx("x.gz")


def test_samples(folder):
    other = folder / "odd.name"
    other.write_text(fasta(RECORDS))
    assert paths.samples([str(other)]) == [("odd.name", 0, str(other))]
    with pytest.raises(ValueError, match="does not exist"):
        paths.samples([str(folder / "missing")])
    with pytest.raises(ValueError, match="Duplicate"):
        paths.samples([str(other), str(other)])
    with pytest.raises(ValueError, match="sample names"):
        paths.samples([str(other)], ["a", "b"])
    (folder / "empty").mkdir()
    with pytest.raises(ValueError, match="No fastx"):
        paths.samples([str(folder / "empty")])


def test_groups(tmp_path):
    (tmp_path / "class_a.fa").write_text(fasta(RECORDS))
    (tmp_path / "class_b").mkdir()
    for n in ("part2.fa", "part1.fa", ".x.fa", "README.txt"):
        (tmp_path / "class_b" / n).write_text(fasta(RECORDS))
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "README.txt").write_text("x")
    assert [(g, n, i, os.path.basename(p)) for g, n, i, p in paths.groups(str(tmp_path))] == [(0, "class_a", 0, "class_a.fa"), (1, "class_b", 0, "part1.fa"), (1, "class_b", 1, "part2.fa")]
    (tmp_path / "class_a").mkdir()
    with pytest.raises(ValueError, match="No fastx"):
        paths.groups(str(tmp_path))
    (tmp_path / "class_a" / "x.fa").write_text(fasta(RECORDS))
    with pytest.raises(ValueError, match="Duplicate"):
        paths.groups(str(tmp_path))
    (tmp_path / "class_a" / "deep").mkdir()
    with pytest.raises(ValueError, match="Nested"):
        paths.groups(str(tmp_path))


def test_background(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for n in ("z.fa", "a/x.fq", "a/b/y.fasta.gz", "a/n.txt"):
        (tmp_path / n).write_text("")
    assert [os.path.relpath(p, tmp_path) for p in paths.background([str(tmp_path)])] == ["a/b/y.fasta.gz", "a/x.fq", "z.fa"]
    with pytest.raises(ValueError):
        paths.background([str(tmp_path / "missing")])


def test_endings_take_one_compression():
    assert all(paths.is_fastx(f"x{a}{c}") for a in paths.FASTX_ENDINGS for c in ("", *paths.COMPRESSIONS))
    assert not any(paths.is_fastx(n) for n in ("x.fa.zst.gz", "x.gz", "x.fa.bz2", "fa", "x.fa.txt"))


def test_background_skips_hidden_folders(tmp_path):
    for name in ("a.fa", "in/b.fq.gz", ".hidden/c.fa", "in/.git/d.fa", "in/.e.fa", "in/deep/f.fasta"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(">x\nACGT\n")
    assert [os.path.relpath(p, tmp_path) for p in paths.background([str(tmp_path)])] == ["a.fa", "in/b.fq.gz", "in/deep/f.fasta"]


@pytest.mark.parametrize("ending", [".fa", ".FASTA.gz", ".fastq.xz", ".fq.zst"])
def test_written_files_read_back(spark, tmp_path, ending):
    rows = [("a b", "ACGT"), ("two\nlines", "AC\nGT>@+é"), (None, None), ("long", random_dna(5000, 3))]
    fastx.write_fastx(spark.createDataFrame(rows, "seq_id string, seq string").repartition(2), str(tmp_path / "x"), ending)
    got = {(r["seq_id"], r["seq"]) for r in fastx.read_samples(spark, [str(tmp_path / "x")]).collect()}
    assert got == {("a b", "ACGT"), ("two lines", "ACNGTNNNN"), ("", ""), ("long", random_dna(5000, 3))}
    assert not [n for n in os.listdir(tmp_path / "x") if n.startswith(".")]


def test_written_ending_is_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="ending"):
        fastx.write_fastx(spark.createDataFrame([("a", "A")], "seq_id string, seq string"), str(tmp_path), ".txt")


def test_urls_go_the_same_way_as_paths(folder, monkeypatch):
    (folder / "sub" / ".dark").mkdir(parents=True)
    for p in ("sub/x.fa", "sub/.dark/y.fa"):
        (folder / p).write_text(">r\nAC\n")
    local = [paths.background([str(folder)]), paths.fastx_files(str(folder))]
    url = f"file://{folder}"
    monkeypatch.setattr(storage, "is_remote", lambda p: "://" in p)
    assert [[p.removeprefix("file://") for p in x] for x in (paths.background([url]), paths.fastx_files(url))] == local
    assert storage.is_dir(url) and not storage.exists(url + "/none") and storage.is_file(url + "/one.fa")
    with fastx.open_plain(url + "/two.fastq.gz") as f:
        assert [x for x in fastx.records(f)] == RECORDS
    with storage.open_output(url + "/new/a.fa") as out:
        out.write(b">r\nAC\n")
    storage.move(url + "/new/a.fa", url + "/new/b.fa")
    assert (folder / "new/b.fa").read_text() == ">r\nAC\n"


def test_files_are_compressed_at_fast_levels():
    """Reads take far longer at the default levels, for a few hundredths (gz) to a fifth (xz) of the size."""
    import io
    import random
    import time
    import zlib

    rng = random.Random(3)
    data = "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate("".join(rng.choice("ACGT") for _ in range(900)) for _ in range(1000))).encode()

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    for ending, slow in ((".gz", lambda: zlib.compress(data, 6)), (".xz", lambda: lzma.compress(data))):
        raw = io.BytesIO()

        def fast(raw=raw, ending=ending):
            out = fastx._compressed(raw, ending)
            out.write(data)
            out.close()

        assert seconds(fast) < 0.7 * seconds(slow), ending
        assert (gzip if ending == ".gz" else lzma).decompress(raw.getvalue()) == data


def test_samples_are_written_in_one_pass_over_the_documents(spark, monkeypatch):
    """One for the samples' names and one for all their files, however many samples there are."""
    from kmerlake.plans import files, tables

    seen, table = spark.sparkContext.accumulator(0), tables.table

    def counted(*args):
        df = table(*args)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    monkeypatch.setattr(tables, "table", counted)
    folders = files._sample_folders(spark, "/root/testdata/sf0.001", "lang")
    assert len(folders) > 2
    assert seen.value == 2 * spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_samples_are_written_as_text_as_dna_spells_them(spark, tmp_path):
    from pyspark.sql import functions as F

    from kmerlake.functions import dna

    every = "".join(map(chr, range(1, 0x250)))
    texts = ["The quick brown fox.", every, "\u212a\u0130\u03a3\U0001f600 a\ud7ff*-.", "", None, "Z" * 70_000]
    rows = [("ab"[i % 2], str(i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "sample string, seq_id string, text string").repartition(2)
    places = {"a": (str(tmp_path / "a"), ".fa.gz"), "b": (str(tmp_path / "b"), ".fq.xz")}
    fastx.write_samples(df.select("sample", "seq_id", F.lower("text").alias("seq")), places, code=dna.TEXT_CODE)
    spelled = F.regexp_replace(F.coalesce(dna.text_as_dna("text"), F.lit("")), "[^A-Za-z*.-]", "N")
    read = fastx.read_samples(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).select("sample", "seq_id", "seq")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, df.select("sample", "seq_id", spelled).collect()))
    with pytest.raises(Exception, match="KeyError"):
        fastx.write_samples(df.select("sample", "seq_id", F.col("text").alias("seq")), {"a": places["a"]})
