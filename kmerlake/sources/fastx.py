"""`spark.read.format("fastx")`: FASTA and FASTQ files, plain, gz, xz or zst, a partition for each range of a file.

The format is told by the first byte. Options: `manifest`, a JSON list of [sample, file number, path or URL], or
`ranges`, one of sources.splits.Range as dictionaries; read_fastx plans those.
Files must be readable by the executors; pipes and stdin are first copied by the driver (spool)
to the folder that `spark.checkpoint.dir` names. `write_fastx` is the way back; its gz and zst files can be split.
"""

from __future__ import annotations

import io
import json
import lzma
import shutil
import struct
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import asdict
from typing import IO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kmerlake.sources import paths, splits, storage

SCHEMA = "sample string, file_idx int, rec_idx long, seq_id string, seq string"
BATCH_BASES = 1 << 22
_LETTERS = bytes(c if chr(c).isascii() and chr(c).isalpha() or chr(c) in "*.-" else ord("N") for c in range(256))


def open_plain(path: str) -> IO[bytes]:
    """The file's bytes, uncompressed, whatever its name says."""
    raw = storage.open_input(path)
    if not hasattr(raw, "peek"):
        raw = io.BufferedReader(raw)
    return splits.inflated(raw, splits.kind_of(raw.peek(18)[:18]))


def records(stream: IO[bytes]) -> Iterator[tuple[str, str]]:
    """(whole header line, sequence) of each record. Sequences may go over several lines; qualities are read past."""
    lines = (line.rstrip(b"\r\n") for line in stream)
    line = next((x for x in lines if x), None)
    while line is not None:
        name = line[1:].decode(errors="replace")
        seq = bytearray()  # a chromosome is millions of lines
        if line[:1] == b">":
            line = next(lines, None)
            while line is not None and line[:1] != b">":
                seq += line
                line = next(lines, None)
        elif line[:1] == b"@":
            line = next(lines, None)
            while line is not None and line[:1] != b"+":
                seq += line
                line = next(lines, None)
            if line is None:
                raise ValueError(f"FASTQ record without a quality line: {name!r}")
            left = len(seq)
            while left > 0:
                quality = next(lines, None)
                if quality is None:
                    raise ValueError(f"FASTQ record is cut short: {name!r}")
                left -= len(quality)
            line = next((x for x in lines if x), None)
        else:
            raise ValueError("neither FASTA nor FASTQ: a record starts with '>' or '@'")
        yield name, seq.decode(errors="replace")


def range_records(r: splits.Range) -> Iterator[tuple[str, str]]:
    whole = r.end_block is None and not r.block and not r.skip
    with open_plain(r.path) if whole else splits.open_range(r) as stream:
        yield from records(stream)


class FastxRange(InputPartition):
    def __init__(self, of: splits.Range):
        self.of = of


class FastxReader(DataSourceReader):
    def __init__(self, ranges: list[splits.Range]):
        self.ranges = ranges

    def __reduce__(self):
        return FastxReader, ([],)  # a task gets its own range, not the plan

    def partitions(self) -> list[FastxRange]:
        return [FastxRange(r) for r in self.ranges]

    def read(self, partition: FastxRange) -> Iterator[pa.RecordBatch]:
        of = partition.of
        names, seqs, at, size, before = [], [], of.first, 0, 0

        def batch() -> pa.RecordBatch:
            n = len(names)
            cols = [pa.array([of.sample] * n), pa.array([of.file_idx] * n, pa.int32()), pa.array(range(at - n, at), pa.int64()), pa.array(names), pa.array(seqs)]
            return pa.RecordBatch.from_arrays(cols, ["sample", "file_idx", "rec_idx", "seq_id", "seq"])

        for name, seq in range_records(of):
            if of.bases is not None and before >= of.bases:
                break
            names.append(name)
            seqs.append(seq)
            at, size, before = at + 1, size + len(seq), before + len(seq)
            if size >= BATCH_BASES:
                yield batch()
                names, seqs, size = [], [], 0
        if names:
            yield batch()


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        given, self.options = self.options, {}  # which tasks would get too
        if "ranges" in given:
            return FastxReader([splits.Range(**r) for r in json.loads(given["ranges"])])
        return FastxReader([splits.Range(*m, kind="") for m in json.loads(given["manifest"])])


def spool(path: str, folder: str | None = None) -> str:
    """A copy in the folder of what can be read only once, made by the driver; other paths as they are."""
    if not paths.is_special(path):
        return path
    copy = f"{folder or tempfile.gettempdir()}/kmerlake-{uuid.uuid4().hex}.fastx"
    with storage.open_output(copy) as out:
        if path == "-":
            shutil.copyfileobj(sys.stdin.buffer, out)
        else:
            with open(path, "rb") as pipe:
                shutil.copyfileobj(pipe, out)
    return copy


def _spool_folder(spark: SparkSession) -> str | None:
    """The cluster's shared folder; None, for a local one, only where none is set."""
    return storage.plain(spark.conf.get("spark.checkpoint.dir", None) or "") or None


def read_fastx(spark: SparkSession, manifest: Sequence[tuple[str, int, str]], limit: int | None = None, numbers: bool = True, split: int = splits.SIZE, through: bool = False) -> DataFrame:
    """manifest: (sample, file number, path), as sources.paths gives it.

    limit: each sample ends with the record that reaches as many bases. numbers: rec_idx counts a file's records, or
    `through` all files those of a sample; without it, it ascends in the file, with gaps, and records of large files need not
    be counted. split: bytes to a partition, more where there would be over splits.RANGES.
    """
    spark.dataSource.register(FastxSource)
    folder = _spool_folder(spark)
    files = [(sample, i, storage.absolute(spool(p, folder))) for sample, i, p in manifest]
    ranges = splits.plan(spark, files, split) if limit is None else splits.planned_limited(spark, files, split, limit)
    if not ranges:
        return spark.createDataFrame([], SCHEMA)
    if numbers:
        ranges = splits.numbered(spark, ranges, through)
    return spark.read.format("fastx").option("ranges", json.dumps([asdict(r) for r in ranges])).load()


class _Blocks(io.RawIOBase):
    """Compresses in blocks that can be read from any one on: BGZF blocks or zstd frames."""

    def __init__(self, raw: IO[bytes], size: int, block, end: bytes = b""):
        self.raw, self.size, self.block, self.end, self.held = raw, size, block, end, bytearray()

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.held += data
        while len(self.held) >= self.size:
            self.raw.write(self.block(bytes(self.held[: self.size])))
            del self.held[: self.size]
        return len(data)

    def close(self) -> None:
        if not self.closed:
            if self.held:
                self.raw.write(self.block(bytes(self.held)))
            self.raw.write(self.end)
        super().close()


def _bgzf_block(data: bytes) -> bytes:
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
    return head + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _compressed(raw: IO[bytes], path: str) -> IO[bytes]:
    if path.endswith(".gz"):
        return _Blocks(raw, 0xFF00, _bgzf_block, _bgzf_block(b""))
    if path.endswith(".xz"):
        return lzma.LZMAFile(raw, "wb", preset=1)
    if path.endswith(".zst"):
        return _Blocks(raw, 1 << 20, lambda data: pa.compress(data, codec="zstd", asbytes=True))
    return raw


def write_fastx(df: DataFrame, folder: str, ending: str = ".fa", stem: str = "part") -> None:
    """df: seq_id, seq. A file for each partition that has rows: {stem}-{partition}{ending}, moved to that name when whole.

    FASTQ endings get the best quality throughout; .gz, .xz and .zst compress. Null sequences are empty;
    characters that no sequence has are written as N, line breaks in names as spaces.
    """
    write_formats(df, {ending: folder}, stem)


def write_formats(df: DataFrame, folders: dict[str, str], stem: str = "part", code: bytes | None = None) -> None:
    """write_fastx to a folder for each ending, in one pass over df. code: a table of bytes (bytes.translate) that
    sequences go through first; it is one table with that of the N, so it costs nothing."""
    _write(df.withColumn("sample", F.lit("")), {"": folders}, stem, code)


def write_samples(df: DataFrame, places: dict[str, tuple[str, str]], stem: str = "part", code: bytes | None = None) -> None:
    """df: sample, seq_id, seq. write_fastx of each sample to its folder with its ending, in one pass over df for all of them.

    A task holds a file of each sample open, so these are to be few. A sample without a place is an error. code: as in write_formats.
    """
    _write(df, {name: {ending: folder} for name, (folder, ending) in places.items()}, stem, code)


def _write(df: DataFrame, places: dict[str, dict[str, str]], stem: str, code: bytes | None) -> None:
    """places: for each sample, a folder for each ending."""
    endings = {e for folders in places.values() for e in folders}
    for ending in endings:
        if not paths.is_fastx("x" + ending):
            raise ValueError(f"not an ending of a sequence file: {ending!r}")

    form = {e: b"@%b\n%b\n+\n%b\n" if e.split(".")[1] in ("fq", "fastq") else b">%b\n%b\n" for e in endings}
    table = _LETTERS if code is None else code.translate(_LETTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        out: dict[tuple[str, str], tuple[IO[bytes], IO[bytes], str]] = {}
        for b in batches:
            for sample, name, letters in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seq = letters.encode("ascii", "replace").translate(table)
                record = (name.encode(), seq, b"I" * len(seq))
                for e, folder in places[sample].items():
                    if (sample, e) not in out:
                        partial = f"{folder}/.{task.taskAttemptId()}-{stem}{e}"
                        raw = storage.open_output(partial)
                        out[sample, e] = _compressed(raw, e), raw, partial
                    out[sample, e][0].write(form[e] % record[: form[e].count(b"%b")])
                n += 1
        for (sample, e), (packed, raw, partial) in out.items():
            packed.close()
            raw.close()
            storage.move(partial, f"{places[sample][e]}/{stem}-{task.partitionId():05d}{e}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    name = F.regexp_replace(F.coalesce(F.col("seq_id").cast("string"), F.lit("")), r"[\r\n]", " ")
    rows = df.select("sample", name.alias("seq_id"), F.coalesce("seq", F.lit("")).alias("seq"))
    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number


def read_samples(spark: SparkSession, inputs: Sequence[str], names: Sequence[str] | None = None, limit: int | None = None, numbers: bool = True, split: int = splits.SIZE, through: bool = False) -> DataFrame:
    return read_fastx(spark, paths.samples(inputs, names), limit, numbers, split, through)


def read_groups(spark: SparkSession, folder: str, numbers: bool = True) -> tuple[DataFrame, list[str]]:
    """(records with group_idx and group, the groups' names)."""
    found = paths.groups(folder)
    names = list(dict.fromkeys(g for _, g, _, _ in found))
    numbers = spark.createDataFrame(list(enumerate(names)), "group_idx int, group string")
    read = read_fastx(spark, [(g, i, p) for _, g, i, p in found], numbers=numbers).withColumnRenamed("sample", "group")
    return read.join(F.broadcast(numbers), "group"), names
