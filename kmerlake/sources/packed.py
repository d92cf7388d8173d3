"""`format("kmerpack")`: sorted k-mer tables as fixed-size binary entries, a k-mer in ceil(k / 4) bytes.

A folder holds part files and, written last by the driver when all parts are whole, `_index.json`: k, the columns beside the
k-mer, and each part's entries. A part is MAGIC, then entries: the k-mer's bytes, highest base first, so bytes sort as
k-mers do, and each column's little-endian bytes (4 for int, 8 for long). A part's length is told by its entries, so
a cut file is noticed before it is read; entries are of one size, so ranges of a part are partitions of their own.
An attempt that fails leaves nothing but its own hidden file, which nothing reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kmerlake.operators.kernel import WIDE
from kmerlake.sources import storage

MAGIC = b"KMERPK01"
MANIFEST = "_index.json"
SPLIT = 32 << 20
ROWS = 1 << 16
_NUMPY = {"int": "<i4", "long": "<i8"}
_SPARK = {"int": T.IntegerType(), "long": T.LongType()}


def _columns(schema: T.StructType) -> list[list[str]]:
    kinds = {v: k for k, v in _SPARK.items()}
    if schema.fields[0].name != "kmer" or any(f.dataType not in kinds for f in schema.fields[1:]):
        raise ValueError("kmerpack holds kmer and columns of int or long")
    return [[f.name, kinds[f.dataType]] for f in schema.fields[1:]]


def _entry(k: int, columns: list) -> np.dtype:
    return np.dtype([("kmer", f"V{-(-k // 4)}"), *((name, _NUMPY[kind]) for name, kind in columns)])


def _to_bytes(kmers: pa.Array, k: int) -> np.ndarray:
    size = -(-k // 4)
    if pa.types.is_decimal(kmers.type):
        words = np.frombuffer(kmers.buffers()[1], np.uint64).reshape(-1, 2)[kmers.offset : kmers.offset + len(kmers)]
        big = np.ascontiguousarray(words[:, ::-1]).astype(">u8").view(np.uint8).reshape(-1, 16)
    else:
        big = kmers.to_numpy(zero_copy_only=False).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(big[:, -size:]).view(f"V{size}").reshape(-1)


def _from_bytes(packed: np.ndarray, k: int) -> pa.Array:
    width, size = (8 if k <= 31 else 16), -(-k // 4)
    big = np.zeros((len(packed), width), np.uint8)
    big[:, -size:] = np.ascontiguousarray(packed).view(np.uint8).reshape(-1, size)
    words = big.view(">u8").astype(np.uint64)
    if k <= 31:
        return pa.array(words.reshape(-1).view(np.int64))
    return pa.Array.from_buffers(WIDE, len(packed), [None, pa.py_buffer(np.ascontiguousarray(words[:, ::-1]))])


@dataclass
class Part(WriterCommitMessage):
    hidden: str
    entries: int


class PackWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, k: int, columns: list):
        self.folder, self.k, self.columns = folder, k, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        hidden, n, entry = f"{self.folder}/.{uuid.uuid4().hex}", 0, _entry(self.k, self.columns)
        with storage.open_output(hidden) as out:
            out.write(MAGIC)
            for b in iterator:
                rows = np.empty(b.num_rows, entry)
                rows["kmer"] = _to_bytes(b.column(0), self.k)
                for i, (name, _) in enumerate(self.columns):
                    rows[name] = b.column(i + 1).to_numpy(zero_copy_only=False)
                out.write(rows.tobytes())
                n += b.num_rows
        return Part(hidden, n)

    def commit(self, messages: list) -> None:
        parts = []
        for i, m in enumerate(m for m in messages if m is not None and m.entries):
            name = f"part-{i:05d}.kmers"
            storage.move(m.hidden, f"{self.folder}/{name}")
            parts.append({"name": name, "entries": m.entries})
        with storage.open_output(f"{self.folder}/{MANIFEST}") as out:
            out.write(json.dumps({"k": self.k, "columns": self.columns, "parts": parts}).encode())

    def abort(self, messages: list) -> None:
        """Hidden files are not part of a table."""


def manifest(folder: str) -> dict:
    """What the folder says it holds; checks that it is a table of this kind and that no part is cut."""
    try:
        with storage.open_input(f"{folder}/{MANIFEST}") as f:
            found = json.loads(f.read())
    except (OSError, ValueError) as e:
        raise ValueError(f"Not a k-mer table: {folder}") from e
    size = _entry(found["k"], found["columns"]).itemsize
    for part in found["parts"]:
        path = f"{folder}/{part['name']}"
        if not storage.exists(path) or storage.size(path) != len(MAGIC) + size * part["entries"]:
            raise ValueError(f"Truncated index: {path}")
    return found


class Stretch(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class PackReader(DataSourceReader):
    def __init__(self, folder: str, found: dict, schema: T.StructType):
        self.folder, self.found, self.names = folder, found, schema.names

    def partitions(self) -> list[Stretch]:
        size = _entry(self.found["k"], self.found["columns"]).itemsize
        rows = max(1, SPLIT // size)
        return [Stretch(f"{self.folder}/{p['name']}", a, min(rows, p["entries"] - a)) for p in self.found["parts"] for a in range(0, p["entries"], rows)] or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        k, columns = self.found["k"], self.found["columns"]
        entry = _entry(k, columns)
        with storage.open_seekable(partition.path) as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"Not a k-mer table: {partition.path}")
            f.seek(len(MAGIC) + partition.first * entry.itemsize)
            for a in range(0, partition.n, ROWS):
                rows = np.frombuffer(f.read(min(ROWS, partition.n - a) * entry.itemsize), entry)
                yield pa.RecordBatch.from_arrays([_from_bytes(rows["kmer"], k), *(pa.array(np.ascontiguousarray(rows[name])) for name, _ in columns)], self.names)


class KmerPack(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kmerpack"

    def schema(self) -> T.StructType:
        found = manifest(self.options["path"])
        kmer = T.LongType() if found["k"] <= 31 else T.DecimalType(38, 0)
        return T.StructType([T.StructField("kmer", kmer), *(T.StructField(n, _SPARK[kind]) for n, kind in found["columns"])])

    def reader(self, schema: T.StructType) -> PackReader:
        return PackReader(self.options["path"], manifest(self.options["path"]), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PackWriter:
        if storage.exists(f"{self.options['path']}/{MANIFEST}"):
            raise ValueError(f"exists already: {self.options['path']}")
        return PackWriter(self.options["path"], int(self.options["k"]), _columns(schema))


def write(kmers: DataFrame, folder: str, k: int) -> None:
    """kmers: kmer first, packed as a number, then columns of int or long."""
    kmers.sparkSession.dataSource.register(KmerPack)
    kmers.write.format("kmerpack").mode("append").option("k", k).save(storage.plain(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(KmerPack)
    return spark.read.format("kmerpack").load(storage.plain(folder))
