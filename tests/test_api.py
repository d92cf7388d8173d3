import pytest
from pyspark.sql import functions as F

from kmerlake import api
from kmerlake.operators import classify as C
from kmerlake.operators import containment as Q
from kmerlake.operators import lenhist as L
from kmerlake.operators import reshape
from kmerlake.sources import index, tsv
from tests.dna_data import fasta, fastq, random_dna, revcomp

GENOMES = {"t1": random_dna(3000, 101), "t2": random_dna(4000, 203), "t3": random_dna(2500, 307)}
COMMON = random_dna(900, 409)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    seqs = {n: g + COMMON for n, g in GENOMES.items()}
    (d / "targets.fa").write_text(fasta(seqs.items()))
    reads = [(f"r{i}", seqs["t1"][i * 100 : i * 100 + 400]) for i in range(30)] * 2 + [(f"s{i}", revcomp(seqs["t2"][i * 150 : i * 150 + 300])) for i in range(10)] + [("none", random_dna(500, 999)), ("short", "ACG"), ("common", COMMON[:600])]
    (d / "s1.fq").write_text(fastq(reads))
    (d / "s2.fa").write_text(fasta([("x", random_dna(2000, 555))]))
    (d / "groups").mkdir()
    for n, g in seqs.items():
        (d / "groups" / f"{n}.fa").write_text(fasta([(n, g)]))
    (d / "common.fa").write_text(fasta([("c", COMMON)]))
    return d


def query(spark, files, **how):
    return api.query(spark, str(files / "targets.fa"), [str(files / "s1.fq"), str(files / "s2.fa")], individual=True, thresholds=[2, 10], **how)


def rows(df):
    return {(r["sample"], r["target"]): r for r in df.collect()}


def test_containment(spark, files):
    got = rows(query(spark, files, confidence=True))
    assert len(got) == 6
    assert got["s1", "t1"]["containment1"] > 0.9 and got["s1", "t1"]["containment2_hits"] > 0 and got["s1", "t1"]["sample_seqs"] == 73
    assert got["s1", "t2"]["containment1"] < got["s1", "t1"]["containment1"]
    assert got["s2", "t3"]["containment1"] == 0 and got["s2", "t3"]["ani_est"] is None
    assert all(r["containment1_lo"] - 1e-9 <= r["containment1"] <= r["containment1_hi"] + 1e-9 for r in got.values())
    assert got["s1", "t2"]["patchiness_z"] > 3  # reads of its first half only


def test_self_containment_is_one_and_own_background_leaves_none(spark, files):
    t = str(files / "targets.fa")
    assert all(r["containment1"] == 1 for r in api.query(spark, t, [t], individual=True).collect())
    assert all(r["target_kmers"] == 0 and r["containment1"] == 0 for r in api.query(spark, t, [t], individual=True, background=[t]).collect())


def test_filters(spark, files):
    plain, own = rows(query(spark, files)), rows(query(spark, files, discriminatory=True))
    masked = rows(query(spark, files, background=[str(files / "common.fa")]))
    for key in plain:
        assert own[key]["target_kmers"] <= masked[key]["target_kmers"] < plain[key]["target_kmers"]
    assert sum(r["target_kmers"] for r in rows(query(spark, files, fraction=0.3)).values()) < sum(r["target_kmers"] for r in plain.values())
    kmers = {r["kmer"] for r in api.dump_syncmers(spark, str(files / "targets.fa"), individual=True, discriminatory=True).collect()}
    shared = [r["kmer"] for r in api.dump_syncmers(spark, str(files / "targets.fa"), individual=True).groupBy("kmer").agg(F.count_distinct("target").alias("n")).filter("n > 1").collect()]
    assert shared and not kmers & set(shared)


def test_merged_targets_and_folder(spark, files):
    one = api.query(spark, str(files / "targets.fa"), [str(files / "s1.fq")]).collect()
    assert [r["target"] for r in one] == ["targets"] and one[0]["target_length"] == sum(map(len, GENOMES.values())) + 3 * len(COMMON)
    assert [r["target"] for r in api.query(spark, str(files / "common.fa"), [str(files / "s1.fq")]).collect()] == ["c"]
    assert {r["target"] for r in api.query(spark, str(files / "groups"), [str(files / "s1.fq")]).collect()} == set(GENOMES)


def test_index_equals_files(spark, files, tmp_path):
    t = str(files / "targets.fa")
    api.build_query_index(spark, t, str(tmp_path / "q"), individual=True, positions=True, fraction=0.5)
    key = ["sample", "target"]
    a = query(spark, files, fraction=0.5, confidence=True).orderBy(*key)
    b = api.query(spark, str(tmp_path / "q"), [str(files / "s1.fq"), str(files / "s2.fa")], thresholds=[2, 10], confidence=True).orderBy(*key)
    cols = [c for c in a.columns if c != "target_idx"]
    assert a.select(cols).collect() == b.select(cols).collect()
    with pytest.raises(ValueError, match="fraction"):
        api.query(spark, str(tmp_path / "q"), [str(files / "s1.fq")], fraction=0.1)
    with pytest.raises(ValueError, match="not a classify"):
        api.classify(spark, str(tmp_path / "q"), [str(files / "s1.fq")])
    api.build_query_index(spark, t, str(tmp_path / "p"), individual=True)
    with pytest.raises(ValueError, match="positions"):
        api.query(spark, str(tmp_path / "p"), [str(files / "s1.fq")], confidence=True)
    info = api.index_info(spark, str(tmp_path / "q")).collect()
    assert {r["name"] for r in info} == set(GENOMES) and info[0]["kind"] == "query" and info[0]["fraction"] == 0.5
    spark.read.parquet(str(tmp_path / "q/kmers")).limit(3).write.parquet(str(tmp_path / "cut/kmers"))
    for part in ("names", "meta"):
        spark.read.parquet(str(tmp_path / f"q/{part}")).write.parquet(str(tmp_path / f"cut/{part}"))
    with pytest.raises(ValueError, match="Truncated"):
        index.load(spark, str(tmp_path / "cut"), "query")
    with pytest.raises(ValueError, match="Not an index"):
        index.load(spark, str(files / "groups"), "query")


def test_classify(spark, files, tmp_path):
    per = {r["seq_id"]: r for r in api.classify(spark, str(files / "groups"), [str(files / "s1.fq")], per_seq=True).collect()}
    assert per["r3"]["group"] == "t1" and per["r3"]["classification"] == "classified"
    assert per["s2"]["group"] == "t2"
    assert per["common"]["classification"] == "ambiguous" and per["common"]["group"] == "t1,t2,t3"
    assert len(set(per["common"]["hits"].split(","))) == 1
    assert (per["none"]["classification"], per["none"]["group"], per["none"]["hits"]) == ("unclassified", ".", "0")
    assert per["short"]["seq_kmers"] == 0 and per["short"]["classification"] == "unclassified"
    own = {r["seq_id"]: r for r in api.classify(spark, str(files / "groups"), [str(files / "s1.fq")], per_seq=True, discriminatory=True).collect()}
    assert own["common"]["classification"] == "unclassified"
    zero = {r["seq_id"]: r for r in api.classify(spark, str(files / "groups"), [str(files / "s1.fq")], per_seq=True, abs_threshold=0).collect()}
    assert zero["none"]["classification"] == "ambiguous" and zero["none"]["hits"] == "0,0,0" and zero["short"]["classification"] == "unclassified"
    api.build_classify_index(spark, str(files / "groups"), str(tmp_path / "c"))
    a = api.classify(spark, str(files / "groups"), [str(files / "s1.fq"), str(files / "s2.fa")])
    b = api.classify(spark, str(tmp_path / "c"), [str(files / "s1.fq"), str(files / "s2.fa")])
    assert a.orderBy("sample", "group").collect() == b.orderBy("sample", "group").collect()
    assert a.count() == 10
    sums = a.groupBy("sample").agg(F.sum("seqs_pct").alias("p"), F.sum("seqs").alias("n")).collect()
    assert all(r["p"] == pytest.approx(100) for r in sums) and {r["n"] for r in sums} == {73, 1}
    lines = list(tsv.summary_lines(a))
    assert lines[0].split("\t")[:2] == ["sample", "group"] and len(lines) == 11


def test_too_many_groups(spark, tmp_path):
    for i in range(129):
        (tmp_path / f"g{i:03d}.fa").write_text(">x\nACGT\n")
    with pytest.raises(ValueError, match="Too many groups"):
        api.classify(spark, str(tmp_path), [str(tmp_path / "g000.fa")])


def test_lenhist(spark, files):
    h = api.lenhist(spark, str(files / "groups"), [str(files / "s1.fq")]).collect()
    assert {r["group"] for r in h} == {"t1", "t2", "ambiguous", "unclassified"}
    assert sum(r["count"] for r in h) == 73 == h[0]["total_seqs_processed"]
    every = api.lenhist(spark, "-", [str(files / "s1.fq")])
    assert {r["group"] for r in every.collect()} == {"all"}
    bins = L.binned(every, 100).collect()
    assert sum(r["n"] for r in bins) == 73 and all(r["density"] == r["n"] / 100 for r in bins)
    curve = L.kde(every, 200).orderBy("i").collect()
    step = curve[1]["x"] - curve[0]["x"]
    assert 30 < sum(r["density"] for r in curve) * step < 73


def test_limit(spark, files):
    limited = api.lenhist(spark, "-", [str(files / "s1.fq")], limit=1000).collect()
    assert sum(r["count"] for r in limited) == 3  # 400 and 800 bases are below the limit


def test_report(spark, files):
    result = query(spark, files, confidence=True).cache()
    lines = [x.split("\t") for x in tsv.report_lines(result, [2, 10], confidence=True)]
    assert lines[0] == ["target", "sample", "containment1", "containment1_hits", "containment1_ci", "patchiness", "ani_est", "containment2", "containment2_hits", "containment2_ci", "containment10", "containment10_hits", "containment10_ci", "median_nz_abundance", "target_kmers", "target_length", "sample_seqs", "sample_bases"]
    assert [x[0] for x in lines[1:]] == ["t1", "t2", "t3", "TOTAL"] * 2 or lines[4][0] == "TOTAL" == lines[8][0]
    first = [float(x[2]) for x in lines[1:4]]
    assert first == sorted(first, reverse=True)
    names = [x.split("\t")[0] for x in tsv.report_lines(result, [2, 10], sort="target", totals=False)][1:]
    assert names == ["t1", "t2", "t3"] * 2
    with pytest.raises(ValueError, match="sort"):
        list(tsv.report_lines(result, [2], sort="size"))
    total = Q.with_totals(result, [2, 10]).filter("is_total AND sample = 's1'").first()
    part = [r for r in result.collect() if r["sample"] == "s1"]
    assert total["containment2_hits"] == sum(r["containment2_hits"] for r in part) and total["target_length"] == 0
    long = reshape.decay(Q.with_totals(result, [2, 10]))
    assert long.count() == 3 * 8
    with pytest.raises(ValueError, match="no decay"):
        reshape.decay(result.select("target", "sample", "containment1"))


def test_tables_round_trip(spark, files, tmp_path):
    for name in ("a", "b"):
        tsv.write_table(api.lenhist(spark, "-", [str(files / "s1.fq")], names=[name]), str(tmp_path / name))
    both = tsv.read_reports(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert {r["sample"] for r in both.collect()} == {"a", "b"}


def test_depth_saturates(spark):
    many = spark.range(70000).select(F.lit("s").alias("sample"), F.lit(1).alias("kmer"))
    assert Q.depths(many).first()["depth"] == 65535


def test_summary_names_all_buckets(spark):
    bucketed = spark.createDataFrame([("s", 1, "unclassified", 0)], "sample string, seq_id int, bucket string, seq_length long")
    got = C.summary(bucketed, spark.createDataFrame([(0, "g")], "group_idx int, group string")).collect()
    assert sorted((r["group"], r["seqs"], r["seqs_pct"], r["bases_pct"]) for r in got) == [("ambiguous", 0, 0.0, 0.0), ("g", 0, 0.0, 0.0), ("unclassified", 1, 100.0, 0.0)]
