"""Token shards: documents in id order as wavelet-matrix files, written and read by Spark tasks.

Documents are dealt by ranges of their id and sorted; every task cuts its run into shards of about
`shard_tokens` ids and writes each to a file of its own (temporary name, then rename, so a task that
runs again leaves the same file). The manifest, one row a shard, is written last.

Defined cases: null texts are empty and hold the end id alone; rows of one id keep together, ordered by
text; a null id sorts first; texts of any length are encoded whole; other columns are ignored; an empty table gives an empty manifest.
The target must be a place that pyarrow's file systems reach (file, hdfs, s3, gs).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.llm import tokens
from kmerlake.llm.wavelet import Shard
from kmerlake.llm.workers import trimmed

SHARD_TOKENS = 1 << 20
NO_ID = -(1 << 63)  # stands for a null doc_id in files


def put(uri: str, data: bytes) -> None:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{TaskContext.get().taskAttemptId()}.part"
    with where.open_output_stream(attempt) as out:
        out.write(data)
    where.move(attempt, path)


def write_shards(docs: DataFrame, path: str, vocabulary: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """docs: doc_id, text. Writes {path}/shards/*.kwm and {path}/manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, part, place = tokens.encoder(vocabulary).encode_all, TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal size, place
            shard = Shard.build(np.concatenate(ids), np.array(names, np.int64), np.array([len(x) for x in ids]), part, place)
            put(f"{path}/shards/{part:06d}-{place:06d}.kwm", shard.to_bytes())
            row = pa.RecordBatch.from_pydict({"part": [part], "place": [place], "n_docs": [len(ids)], "n_tokens": [size]})
            ids.clear()
            names.clear()
            size, place = 0, place + 1
            return row

        for batch in batches:
            docs_ = batch.column(0).fill_null(NO_ID).to_numpy()
            for row, found, of in encode_all(batch.column(1)):
                for i in range(len(of) - 1):
                    ids.append(found[of[i] : of[i + 1]])
                    names.append(int(docs_[row + i]))
                    size += len(ids[-1])
                    if size >= shard_tokens:
                        yield close()
        if ids:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(trimmed(write), "part long, place long, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, place, n_docs, n_tokens and start: the ids in all shards before. One row a task is summed in one place."""
    rows = spark.read.parquet(f"{path}/manifest")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", before.alias("_before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(parts, "part").select("part", "place", "n_docs", "n_tokens", (F.col("_before") + F.col("_inside")).alias("start"))


def _shards(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.kwm").option("recursiveFileLookup", "true")
    return files.load(path).select("content")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for content in batch.column(0):
            yield Shard.from_bytes(content.as_py())


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids (unsigned 32-bit little-endian bytes)."""
    fields = ["part", "place", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _each(batches):
            data, ends = memoryview(s.decode().astype("<u4").tobytes()), np.cumsum(s.lengths.astype(np.int64))
            cut = [data[4 * int(b - n) : 4 * int(b)] for b, n in zip(ends, s.lengths.astype(np.int64), strict=True)]
            n = len(cut)
            out = [np.full(n, s.part), np.full(n, s.place), pa.array(s.doc_ids, mask=s.doc_ids == NO_ID), ends - s.lengths.astype(np.int64), s.lengths.astype(np.int64), np.array([zlib.crc32(x) for x in cut], np.int64)]
            out += [pa.array([bytes(x) for x in cut], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in out], fields)

    docs = _shards(spark, path).mapInArrow(trimmed(read), ", ".join(f"{f} {'binary' if f == 'ids' else 'long'}" for f in fields))
    start = (F.col("start") + F.col("inside")).alias("start")
    return docs.join(manifest(spark, path).select("part", "place", "start"), ["part", "place"]).select("doc_id", start, *fields[4:])


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of token in each shard, by rank alone."""

    def count(batches):
        for s in _each(batches):
            yield pa.RecordBatch.from_pydict({"part": [s.part], "place": [s.place], "n": [s.count(token)]})

    return _shards(spark, path).mapInArrow(trimmed(count), "part long, place long, n long")


def locate_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every occurrence of token: doc_id and its place in the document, by select."""

    def locate(batches):
        for s in _each(batches):
            at, ends = s.locate(token), np.cumsum(s.lengths.astype(np.int64))
            doc = np.searchsorted(ends, at, "right")
            starts = ends - s.lengths.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[doc], mask=s.doc_ids[doc] == NO_ID), pa.array(at - starts[doc], pa.int64())], ["doc_id", "place"])

    return _shards(spark, path).mapInArrow(trimmed(locate), "doc_id long, place long")
