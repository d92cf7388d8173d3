"""The command line: text out of files, as the API's results."""

import pytest

from kmerlake import __main__ as command
from tests.dna_data import fasta, random_dna


@pytest.fixture
def files(tmp_path):
    genomes = [random_dna(900, i) for i in range(3)]
    (tmp_path / "t.fa").write_text(fasta([(f"t{i}", g) for i, g in enumerate(genomes)]))
    for i, g in enumerate(genomes[:2]):
        (tmp_path / "groups").mkdir(exist_ok=True)
        (tmp_path / "groups" / f"g{i}.fa").write_text(fasta([("x", g)]))
    for name, own in (("b", (0, 1)), ("a", (2,))):
        (tmp_path / f"{name}.fa").write_text(fasta([(f"r{j}", genomes[i][j * 20 : j * 20 + 300]) for i in own for j in range(20)]))
    return tmp_path


def run(spark, capsys, *argv):
    assert command.main([str(a) for a in argv], spark) == 0
    return [line.split("\t") for line in capsys.readouterr().out.splitlines()]


def test_query(spark, files, capsys):
    got = run(spark, capsys, "query", files / "t.fa", files / "b.fa", files / "a.fa", "-i", "-c", "-a", "2,10", "--sort", "input", "-l", "1M")
    assert got[0][:4] == ["target", "sample", "containment1", "containment1_hits"] and got[0][-1] == "sample_bases"
    assert [(r[0], r[1]) for r in got[1:]] == [(t, s) for s in "ba" for t in ("t0", "t1", "t2", "TOTAL")]
    few = run(spark, capsys, "query", files / "t.fa", files / "b.fa", "-i", "--no-total", "-l", "301")
    assert {r[-1] for r in few[1:]} == {"600"} and len(few) == 4


def test_groups_indexes_and_histograms(spark, files, capsys):
    built = run(spark, capsys, "index", "build-classify", files / "groups", files / "c", "--form", "packed")
    assert {r[0] for r in built[1:]} == {"g0", "g1"} and run(spark, capsys, "index", "info", files / "c") == built
    by_index, by_files = (run(spark, capsys, "classify", x, files / "b.fa", files / "a.fa") for x in (files / "c", files / "groups"))
    assert by_index == by_files and by_index[0] == ["sample", "group", "seqs_pct", "seqs", "bases_pct", "bases"] and [r[0] for r in by_index[1:]] == ["b"] * 4 + ["a"] * 4
    reads = run(spark, capsys, "classify", files / "c", files / "b.fa", "--per-seq")
    assert len(reads) == 41
    lengths = run(spark, capsys, "lenhist", "-", files / "b.fa")
    assert lengths[1][:4] == ["b", "all", "300", "40"]
    run(spark, capsys, "index", "build-query", files / "t.fa", files / "q", "-i", "--positions")
    assert run(spark, capsys, "dump", files / "q")[1:] and sorted(run(spark, capsys, "dump", files / "q")) == sorted(run(spark, capsys, "dump", files / "t.fa", "-i"))


def test_errors_and_files(spark, files, capsys):
    assert command.main(["query", str(files / "t.fa"), str(files / "none.fa")], spark) == 1
    assert "does not exist" in capsys.readouterr().err
    assert command.main(["lenhist", "-", str(files / "a.fa"), "-o", str(files / "out.tsv")], spark) == 0
    assert (files / "out.tsv").read_text().splitlines()[1].split("\t")[3] == "20"
    with pytest.raises(SystemExit):
        command.main(["nothing"], spark)
