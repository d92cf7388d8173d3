"""Registered queries that go through files: sequence files in and out, indexes, reports, streams.

Each writes the driver's tables to a new folder in the session's shared one and works on what it reads from there.
"""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake import api
from kmerlake.functions import dna
from kmerlake.operators import containment as Q
from kmerlake.operators import lenhist as L
from kmerlake.operators import targets as T
from kmerlake.operators.classify import group_index
from kmerlake.plans import oracles as O
from kmerlake.plans import tables
from kmerlake.sources import fastx, paths, shared, storage, tsv
from kmerlake.streaming import depths, incremental

K, S = O.K, O.S
THRESHOLDS = (10, 2, 1)
FORMATS = {"plain": ".fa", "zipped": ".FASTA.gz", "xz": ".fastq.xz", "zst": ".fq.zst"}
QUERIES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


folder = shared.folder


def _items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, seq_id, seq of the benchmark items, as a sequence file can hold them."""
    seq = F.regexp_replace("seq", "[^A-Za-z*.-]", "N").alias("seq")
    return tables.targets(spark, d).select(F.col("target_idx").alias("item_id"), F.col("target").alias("seq_id"), seq)


def _one_file(df: DataFrame, path: str, stem: str, ending: str = ".fa") -> None:
    """One file is one stream, so one task writes it."""
    fastx.write_fastx(df.coalesce(1), path, ending, stem)


def _target_files(spark: SparkSession, d: str) -> list[str]:
    """Files of targets, in their order over all files."""
    root = folder(spark)
    fastx.write_fastx(_items(spark, d).repartitionByRange(3, "item_id").sortWithinPartitions("item_id"), root, ".fa")
    return paths.fastx_files(root)


def _group_folder(spark: SparkSession, d: str) -> str:
    """Groups 0 and 1 as a file each, 2 and 3 as folders of files."""
    root, items = folder(spark), _items(spark, d)
    for g in range(tables.N_GROUPS):
        own = items.filter(F.pmod("item_id", F.lit(tables.N_GROUPS)) == g)
        if g < 2:
            _one_file(own, root, f"group{g}", ".fa.gz")
            storage.move(f"{root}/group{g}-00000.fa.gz", f"{root}/group{g}.fa.gz")
        else:
            fastx.write_fastx(own.repartition(3), f"{root}/group{g}", ".fq.xz")
    return root


def _sample_folders(spark: SparkSession, d: str, column: str) -> list[str]:
    """A folder of files for each sample; all are written in one pass over the documents."""
    root, docs, endings = folder(spark), tables.documents(spark, d, column), list(FORMATS.values())
    names = sorted(r[0] for r in tables.table(spark, d, "documents").select(column).distinct().collect())  # a few
    places = {name: (f"{root}/{name}", endings[i % len(endings)]) for i, name in enumerate(names)}
    fastx.write_samples(docs.select("sample", "seq_id", F.lower("text").alias("seq")), places, code=dna.TEXT_CODE)
    return [f"{root}/{n}" for n in names]


# sequence files


@_query
def file_formats(spark, d):
    """Folders of files in all formats as samples."""
    root = folder(spark)
    for name, ending in FORMATS.items():
        fastx.write_fastx(_items(spark, d).repartition(3), f"{root}/{name}", ending)
    return fastx.read_samples(spark, [f"{root}/{n}" for n in FORMATS]).select("sample", "seq_id", "seq")


@_query
def file_names(spark, d):
    """Files given one by one: a sample each, named after the file; records are numbered in their order."""
    root, items = folder(spark), _items(spark, d)
    for stem, ending in (("a.b", ".fa"), ("c", ".fq.gz")):
        _one_file(items.orderBy("item_id"), root, stem, ending)
    read = fastx.read_samples(spark, [f"{root}/a.b-00000.fa", f"{root}/c-00000.fq.gz"])
    return read.select("sample", "rec_idx", "seq_id", F.length("seq").cast("long").alias("length"))


@_query
def file_groups(spark, d):
    read, _ = fastx.read_groups(spark, _group_folder(spark, d))
    return read.select("group_idx", "group", "seq_id", "seq")


def _read_files(spark: SparkSession, d: str, endings: Sequence[str]) -> dict[str, str]:
    """Documents as sequence files of each ending, in order of their ids over all files: a folder for each."""
    docs, folders = tables.table(spark, d, "documents").select("doc_id", "text"), {e: folder(spark) for e in endings}
    dealt = docs.repartitionByRange(tables.parts(docs, 3), "doc_id").sortWithinPartitions("doc_id")
    fastx.write_formats(dealt.select(F.col("doc_id").alias("seq_id"), F.lower("text").alias("seq")), folders, code=dna.TEXT_CODE)
    return folders


SPLIT_FORMATS = (".fa", ".fq.gz", ".fa.zst")
SPLIT_BYTES = 100_000
LIMIT = 300_000


@_query
def file_split(spark, d):
    """Large files, plain and in blocks, as many partitions: the records and their numbers are those of the whole files."""
    roots = _read_files(spark, d, SPLIT_FORMATS)
    read = fastx.read_samples(spark, list(roots.values()), list(roots), split=SPLIT_BYTES, through=True)
    return read.select("sample", F.col("rec_idx").alias("number"), F.col("seq_id").cast("long").alias("doc_id"), "seq")


@_query
def file_limit(spark, d):
    """Reads of a folder of files up to a number of bases; the files' ranges behind it are not opened."""
    read = fastx.read_samples(spark, list(_read_files(spark, d, [".fq"]).values()), ["reads"], limit=LIMIT, numbers=False, split=SPLIT_BYTES)
    return read.select("sample", F.col("seq_id").cast("long").alias("doc_id"), F.length("seq").cast("long").alias("length"))


@_query
def file_pipe(spark, d):
    """A named pipe, read once by the driver into the shared folder."""
    local = tempfile.mkdtemp(prefix="spark-kmerlake-", dir="/tmp")
    pipe = os.path.join(local, "pipe")
    os.mkfifo(pipe)

    def feed() -> None:
        with open(pipe, "w") as out:
            for r in _items(spark, d).toLocalIterator():
                out.write(f">{r['seq_id']}\n{r['seq']}\n")

    writer = threading.Thread(target=feed)
    writer.start()
    read = fastx.read_samples(spark, [pipe])
    writer.join()
    return read.select("sample", "seq_id", "seq")


@_query
def file_background(spark, d):
    """Masked by files at any depth; those in hidden folders, and with endings of no sequence file, do not count."""
    root, items = folder(spark), _items(spark, d)
    for g, place in enumerate(("deep/down", ".hidden", "visible", "deep/.too/down")):
        fastx.write_fastx(items.filter(F.pmod("item_id", F.lit(4)) == g).repartition(2), f"{root}/{place}", ".fa.xz")
    fastx.write_fastx(items.repartition(2), f"{root}/odd", ".fa.gz")
    for i, path in enumerate(paths.fastx_files(f"{root}/odd")):
        storage.move(path, f"{root}/odd/{i}.fa.zst.gz")
    tk = T.build(items.select(F.col("item_id").alias("target_idx"), F.col("seq_id").alias("target"), "seq"), K, S).kmers
    return api.background_hits(spark, tk, [root], K, S).select(dna.decode("kmer", K).alias("kmer"))


@_query
def file_targets(spark, d):
    """A folder's files and folders as targets, each of the records of its files."""
    found, _, _, _ = api.load_targets(spark, _group_folder(spark, d), K, S)
    n = T.distinct_kmers(found.kmers).groupBy("target_idx").agg(F.count("*").alias("n"))
    return found.info.join(n, "target_idx", "left").select("target", "length", F.coalesce("n", F.lit(0)).alias("target_kmers"))


# analyses over files


@_query
def file_query(spark, d):
    """The records of a file as targets, in folders of reads."""
    out = api.query(spark, _target_files(spark, d), _sample_folders(spark, d, "lang"), k=K, s=S, individual=True, thresholds=THRESHOLDS)
    return out.select("sample", "target", *(F.round(f"containment{t}", 8).alias(f"containment{t}") for t in (1, 2, 10)), "containment2_hits", "containment10_hits", "target_length", "sample_seqs", "sample_bases")


@_query
def file_query_index(spark, d):
    """A built index as targets."""
    root = folder(spark)
    api.build_query_index(spark, _target_files(spark, d), f"{root}/index", k=K, s=S, individual=True, positions=True)
    return api.dump_syncmers(spark, f"{root}/index")


@_query
def file_classify(spark, d):
    """Reads of folders by a built index."""
    path = f"{folder(spark)}/index"
    api.build_classify_index(spark, _group_folder(spark, d), path, k=K, s=S)
    return api.classify(spark, path, _sample_folders(spark, d, "source"), per_seq=True)


@_query
def file_lenhist(spark, d):
    return api.lenhist(spark, "-", _sample_folders(spark, d, "source"))


# reports


def _lines(spark: SparkSession, lines) -> DataFrame:
    """The lines of a report: samples by targets, or samples by groups."""
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


@_query
def report_text(spark, d):
    out = Q.containment(T.build(tables.targets(spark, d), K, S), tables.reads(spark, d), K, S, THRESHOLDS, True)
    return _lines(spark, tsv.report_lines(out, THRESHOLDS, confidence=True, sort="input"))


@_query
def report_reread(spark, d):
    """Histograms of two runs as text files, read back as one table; the second has a column more."""
    root, hist = folder(spark), L.histogram(L.all_in_one(tables.turns(spark, d)))
    tsv.write_table(hist.select("sample", "group", "length", "count"), f"{root}/a")
    tsv.write_table(hist.select("sample", "group", "length", "count", "group_bases"), f"{root}/b")
    back = tsv.read_reports(spark, [f"{root}/a", f"{root}/b"])
    return back.select("sample", "group", *(F.col(c).cast("long").alias(c) for c in ("length", "count", "group_bases")))


# streams


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(tables.table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _reads_stream(spark: SparkSession, d: str) -> DataFrame:
    docs = _stream(spark, d, "documents")
    return docs.select(F.col("lang").alias("sample"), F.col("doc_id").alias("seq_id"), dna.text_as_dna("text").alias("seq"))


def _ran(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream has put out when all that was there is read; in complete mode the last batch's table."""
    spark, root = stream.sparkSession, folder(stream.sparkSession)
    write = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        write = write.format("parquet").option("path", f"{root}/rows")
    else:
        write = write.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/rows"))
    write.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


@_query
def stream_abundance(spark, d):
    tk = T.build(tables.targets(spark, d), K, S).kmers
    got = _ran(incremental.streaming_abundance(_reads_stream(spark, d), tk, K, S), "complete")
    return got.select("sample", dna.decode("kmer", K).alias("kmer"), "depth")


@_query
def stream_depths(spark, d):
    """The same counts as updates of a stateful processor, in two micro-batches."""
    tk, root = T.build(tables.targets(spark, d), K, S).kmers, folder(spark)
    docs = tables.table(spark, d, "documents").select("lang", "text")
    n = tables.parts(docs, 4)
    reads = docs.repartition(n).select(F.col("lang").alias("sample"), dna.text_as_dna("text").alias("seq"))
    reads.write.parquet(f"{root}/reads")
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", -(-n // 2)).parquet(f"{root}/reads")
    updates = depths.depth_updates(stream, tk, K, S)
    depths.start(updates, f"{root}/rows", f"{root}/state").awaitTermination()
    return depths.latest(spark, f"{root}/rows", updates.schema).select("sample", dna.decode("kmer", K).alias("kmer"), "depth")


@_query
def stream_read_hits(spark, d):
    index = group_index(tables.groups(spark, d), K, S)
    got = _ran(incremental.streaming_read_hits(_reads_stream(spark, d), index, K, S), "append")
    return got.select("sample", "seq_id", "group_idx", dna.decode("kmer", K).alias("kmer"))


@_query
def stream_windows(spark, d):
    """Events as reads: counts and lengths of their properties by hour."""
    events = _stream(spark, d, "events").select(F.col("event_type").alias("sample"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("seq"))
    got = _ran(incremental.windowed_sample_stats(events, "ts", "1 day", "1 hour"), "complete")
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "sample", "sample_seqs", "sample_bases")


_FIELDS = f"item_id, 'item ' || item_id AS seq_id, regexp_replace({O.dna('text')}, '[^A-Za-z*.-]', 'N', 'g') AS seq"
_CI = [f"CASE WHEN is_total THEN '-' ELSE printf('%.3f-%.3f', {lo}, {hi}) END" for lo, hi in (O.wilson(f"h{t}", "n") for t in (1, 2, 10))]
_Z = "CASE WHEN z IS NULL OR z <= 0 OR p > 0.05 THEN '-' WHEN p < 1e-16 THEN printf('%.1f|<1e-16', z) ELSE printf('%.1f|', z) || regexp_replace(printf('%.0e', p), 'e-0*', 'e-') END"
_CELLS = [
    "target", "sample", "printf('%.3f', c1)", "h1::VARCHAR", _CI[0], _Z, "coalesce(printf('%.3f', ani_est), '-')",
    "printf('%.3f', c2)", "h2::VARCHAR", _CI[1], "printf('%.3f', c10)", "h10::VARCHAR", _CI[2],
    "CASE WHEN is_total THEN '-' ELSE printf('%.0f', med) END", "n::VARCHAR", "target_length::VARCHAR", "sample_seqs::VARCHAR", "sample_bases::VARCHAR",
]
_HEAD = "target sample containment1 containment1_hits containment1_ci patchiness ani_est containment2 containment2_hits containment2_ci containment10 containment10_hits containment10_ci median_nz_abundance target_kmers target_length sample_seqs sample_bases"

ORACLES: dict[str, str] = {
    "file_formats": f"WITH r AS (SELECT {_FIELDS} FROM benchmark)\nSELECT f AS sample, seq_id, seq FROM r, (SELECT unnest({list(FORMATS)}) AS f)",
    "file_names": f"WITH r AS (SELECT {_FIELDS} FROM benchmark)\nSELECT f AS sample, row_number() OVER (PARTITION BY f ORDER BY item_id) - 1 AS rec_idx, seq_id, length(seq)::BIGINT AS length FROM r, (SELECT unnest(['a.b-00000', 'c-00000']) AS f)",
    "file_groups": f"SELECT (item_id % 4)::INT AS group_idx, 'group' || (item_id % 4) AS \"group\", seq_id, seq FROM (SELECT {_FIELDS} FROM benchmark)",
    "file_split": f"SELECT f AS sample, row_number() OVER (PARTITION BY f ORDER BY doc_id) - 1 AS number, doc_id, regexp_replace({O.dna('text')}, '[^A-Za-z*.-]', 'N', 'g') AS seq FROM documents, (SELECT unnest({list(SPLIT_FORMATS)}) AS f)",
    "file_limit": f"SELECT 'reads' AS sample, doc_id, length(text)::BIGINT AS length FROM documents QUALIFY coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {LIMIT}",
    "file_pipe": f"SELECT 'pipe' AS sample, seq_id, seq FROM (SELECT {_FIELDS} FROM benchmark)",
    "file_background": f"WITH {O.TARGETS}\nSELECT DISTINCT kmer FROM tk WHERE id % 2 = 0",
    "file_targets": f"WITH {O.MERGED}\nSELECT o.target, max(o.length) AS length, count(DISTINCT kmer)::BIGINT AS target_kmers FROM o LEFT JOIN mk USING (g) GROUP BY o.g, o.target",
    "file_query": f"WITH {O.FULL}\nSELECT sample, target, round(c1, 8) AS containment1, round(c2, 8) AS containment2, round(c10, 8) AS containment10, h2 AS containment2_hits, h10 AS containment10_hits, target_length, sample_seqs, sample_bases FROM c",
    "file_query_index": f"WITH {O.TARGETS}\n{O.DUMP_T}",
    "file_classify": f"WITH {O.classified(O.BY_SOURCE)}\nSELECT sample, seq_id::VARCHAR AS seq_id, classification, \"group\", hits, seq_kmers, seq_length FROM ps",
    "file_lenhist": f"WITH bu AS (SELECT source AS sample, 'all' AS bucket, length(text)::BIGINT AS seq_length FROM documents),\n{O.lenhist('bu')}\nSELECT * FROM lh",
    "report_text": f"""WITH {O.FULL},
{O.TOTALS},
{O.HIST},
{O.ANI},
{O.patchy("tk", "id", "r")},
zp AS (SELECT sample, id, z, CASE WHEN z IS NOT NULL THEN {O.survival("z")} END AS p FROM pz)
SELECT 0::BIGINT AS line_no, replace('{_HEAD}', ' ', chr(9)) AS line
UNION ALL SELECT row_number() OVER (ORDER BY tot.sample, is_total, tot.id NULLS LAST)::BIGINT, concat_ws(chr(9), {", ".join(_CELLS)})
FROM (SELECT tot.*, ani.ani_est, zp.z, zp.p FROM tot LEFT JOIN ani ON ani.sample = tot.sample AND ani.id = tot.id LEFT JOIN zp ON zp.sample = tot.sample AND zp.id = tot.id) tot""",
    "report_reread": f"WITH {O.ALL_TURNS}\nSELECT sample, \"group\", length, count, NULL::BIGINT AS group_bases FROM lh UNION ALL SELECT sample, \"group\", length, count, group_bases FROM lh",
    "stream_abundance": f"WITH {O.FULL}\nSELECT sample, kmer, depth FROM ab",
    "stream_depths": f"WITH {O.FULL}\nSELECT sample, kmer, depth FROM ab",
    "stream_read_hits": f"WITH {O.MERGED},\n{O.READS},\nx AS (SELECT DISTINCT kmer, g FROM mk)\nSELECT r.sample, r.id AS seq_id, g::INT AS group_idx, kmer FROM rk JOIN r USING (id) JOIN x USING (kmer)",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type AS sample, count(*)::BIGINT AS sample_seqs, coalesce(sum(length(props)), 0)::BIGINT AS sample_bases FROM events GROUP BY ALL",
}
