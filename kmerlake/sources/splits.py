"""Ranges of sequence files, so that one large file is many partitions.

A range begins where a record does: the tasks that plan ranges look from every `size` bytes on for the next record.
In FASTA that is a line that begins with `>`; in FASTQ a line with `@` whose next lines are a sequence, `+`
and a quality of the sequence's length, and that a second such record, or the end, follows. Records that
go over several lines are whole as long as such a place exists; where none is found, a range goes on to the next one that
has. Plain files are cut anywhere, block-gzipped ones (BGZF) and zstd files of several frames at
blocks or frames, a range's place being that of the block and the bytes after it in the text. A block start is proved by the
blocks that follow. Other gz, xz and zst files are one range.
"""

from __future__ import annotations

import gzip
import io
import json
import lzma
import struct
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from typing import IO

import pyarrow as pa
from pyspark.sql import SparkSession

from kmerlake.sources import storage

SIZE = 64 << 20
RANGES = 1 << 10  # of a plan, before ranges become larger than asked for; none becomes larger than SIZE for it
PROBE = 1 << 18  # bytes first read in search of a record
PLAIN, GZIP, BGZF, XZ, ZSTD = "plain", "gzip", "bgzf", "xz", "zstd"
SPLITTABLE = (PLAIN, BGZF, ZSTD)
_BGZF_HEAD = 18
_ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


@dataclass(frozen=True)
class Range:
    """Records of a file from a place to another; a place is a block and the bytes after it. rec_idx counts from `first`.

    bases: stop when the records before have as many.
    """

    sample: str
    file_idx: int
    path: str
    kind: str = PLAIN
    block: int = 0
    skip: int = 0
    end_block: int | None = None
    end_skip: int = 0
    first: int = 0
    bases: int | None = None


def kind_of(head: bytes) -> str:
    """By the first bytes, whatever the name says."""
    if head.startswith(b"\x1f\x8b"):
        return BGZF if _bgzf_size(head) else GZIP
    if head.startswith(b"\xfd7zXZ\x00"):
        return XZ
    return ZSTD if head.startswith(_ZSTD_MAGIC) else PLAIN


class _Slice(io.RawIOBase):
    """The next bytes of a stream, `left` at most."""

    def __init__(self, raw: IO[bytes], left: int | None):
        self.raw, self.left = raw, left

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        n = len(b) if self.left is None else min(len(b), self.left)
        data = self.raw.read(n) if n else b""
        b[: len(data)] = data
        if self.left is not None:
            self.left -= len(data)
        return len(data)


class _Chain(io.RawIOBase):
    """Streams one after the other."""

    def __init__(self, streams: list[IO[bytes]]):
        self.streams = streams

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while self.streams:
            data = self.streams[0].read(len(b))
            if data:
                b[: len(data)] = data
                return len(data)
            self.streams.pop(0).close()
        return 0


def inflated(raw: IO[bytes], kind: str) -> IO[bytes]:
    """The text of a stream that begins with a block, frame or file."""
    if kind in (GZIP, BGZF):
        return io.BufferedReader(gzip.GzipFile(fileobj=raw))
    if kind == XZ:
        return io.BufferedReader(lzma.LZMAFile(raw))
    if kind == ZSTD:
        return io.BufferedReader(pa.CompressedInputStream(pa.PythonFile(raw, mode="r"), "zstd"))
    return raw


def _from_block(path: str, kind: str, block: int, end: int | None) -> IO[bytes]:
    raw = storage.open_seekable(path)
    raw.seek(block)
    return inflated(io.BufferedReader(_Slice(raw, None if end is None else end - block), 1 << 20), kind)


def _skip(stream: IO[bytes], n: int) -> None:
    while n > 0:
        got = len(stream.read(min(n, 1 << 20)))
        if not got:
            raise ValueError("a sequence file has changed since its ranges were planned")
        n -= got


def open_range(r: Range) -> IO[bytes]:
    """The text of a range. Its first record may lie behind the block that it ends in."""
    text = _from_block(r.path, r.kind, r.block, r.end_block)
    if r.end_skip:
        rest = _Slice(_from_block(r.path, r.kind, r.end_block, None), r.end_skip)
        text = io.BufferedReader(_Chain([text, io.BufferedReader(rest)]), 1 << 20)
    _skip(text, r.skip)
    return text


# where blocks begin


def _bgzf_size(head: bytes) -> int:
    """Bytes of the block that begins with these, 0 if none does."""
    if len(head) < _BGZF_HEAD or head[:4] != b"\x1f\x8b\x08\x04" or head[12:16] != b"BC\x02\x00":
        return 0
    return struct.unpack_from("<H", head, 16)[0] + 1


def _is_bgzf(raw: IO[bytes], at: int) -> bool:
    """Three blocks in a row, or blocks up to the end."""
    for _ in range(3):
        raw.seek(at)
        head = raw.read(_BGZF_HEAD)
        if not head:
            return True
        size = _bgzf_size(head)
        if not size:
            return False
        at += size
    return True


def _zstd_end(raw: IO[bytes], at: int) -> int:
    """Where the frame that begins at `at` ends, by its blocks' headers; 0 if it is none."""
    raw.seek(at)
    head = raw.read(5)
    if len(head) < 5 or head[:4] != _ZSTD_MAGIC:
        return 0
    flags = head[4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    last = 0
    while not last:
        raw.seek(at)
        block = raw.read(3)
        if len(block) < 3:
            return 0
        x = int.from_bytes(block, "little")
        last, kind = x & 1, x >> 1 & 3
        if kind == 3:
            return 0
        at += 3 + (1 if kind == 1 else x >> 3)
    return at + 4 * (flags >> 2 & 1)


def _is_zstd(raw: IO[bytes], at: int, size: int) -> bool:
    end = _zstd_end(raw, at)
    raw.seek(end)
    return end == size or 0 < end < size and raw.read(4) == _ZSTD_MAGIC


def _next_block(path: str, kind: str, at: int, until: int, size: int) -> int | None:
    """The first block from `at` on, before `until`."""
    magic = b"\x1f\x8b\x08\x04" if kind == BGZF else _ZSTD_MAGIC
    raw = storage.open_seekable(path)
    with raw:
        place, data = at, b""
        while place < until:
            raw.seek(place)
            data = raw.read(min(1 << 20, until - place) + len(magic) - 1)
            found = data.find(magic)
            while found >= 0:
                here = place + found
                if _is_bgzf(raw, here) if kind == BGZF else _is_zstd(raw, here, size):
                    return here
                found = data.find(magic, found + 1)
            place += 1 << 20
    return None


# where records begin


def _fastq_record(text: bytes, at: int, ended: bool) -> int | None:
    """The place behind the record of four lines at `at`; -1 if there is none, None if the text is too short to tell."""
    ends = []
    for _ in range(4):
        end = text.find(b"\n", ends[-1] + 1 if ends else at)
        if end < 0:
            if not ended or len(ends) < 3:
                return -1 if ended else None
            end = len(text)
        ends.append(end)
    lines = [text[a:b].rstrip(b"\r") for a, b in zip([at, *(e + 1 for e in ends[:3])], ends, strict=True)]
    whole = lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1]) == len(lines[3])
    return min(ends[3] + 1, len(text)) if whole else -1


def record_start(text: bytes, fasta: bool, ended: bool) -> int | None:
    """The first place behind a line break where a record is sure to begin; None if this text has none that can be told."""
    if fasta:
        found = text.find(b"\n>")
        return None if found < 0 else found + 1
    at = text.find(b"\n") + 1
    while at:
        if text[at : at + 1] == b"@":
            after = _fastq_record(text, at, ended)
            if after is None:
                return None
            if after >= 0:
                if ended and not text[after:].strip():
                    return at
                second = _fastq_record(text, after, ended)
                if second is None:
                    return None
                if second >= 0:
                    return at
        at = text.find(b"\n", at) + 1
    return None


def _place(path: str, kind: str, at: int, until: int, size: int, fasta: bool) -> tuple[int, int] | None:
    """The first place of a record from byte `at` on."""
    # a plain file's record may begin at `at` itself, behind the line break before it
    block = at - 1 if kind == PLAIN else _next_block(path, kind, at, until, size)
    if block is None:
        return None
    with _from_block(path, kind, block, None) as stream:
        text, more = b"", PROBE
        while True:
            new = stream.read(more)
            text += new
            found = record_start(text, fasta, len(new) < more)
            if found is not None:
                return (block + found, 0) if kind == PLAIN else (block, found)
            if len(new) < more:
                return None
            more = len(text)


def _on_executors(spark: SparkSession, tasks: Sequence[dict], work, schema: str) -> dict[int, tuple]:
    """work(task) of each task, by number. Rows are few numbers for each range of a file."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, task in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = work(json.loads(task))
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64())} | {f: pa.array([x], pa.int64()) for f, x in zip(fields, out, strict=True)})

    if not tasks:
        return {}
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(tasks)], "i long, task string")
    rows = rows.repartition(min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
    return {r[0]: tuple(r[1:]) for r in rows.mapInArrow(run, f"i long, {schema}").collect()}


def plan(spark: SparkSession, manifest: Sequence[tuple[str, int, str]], size: int = SIZE) -> list[Range]:
    """The ranges of about `size` bytes of (sample, file number, path), in order; larger ones where there would be more than RANGES.

    Numbers ascend in a file, with gaps between its ranges.
    """
    ranges, probes, totals = [], [], [storage.size(path) for _, _, path in manifest]
    size = max(size, min(SIZE, sum(totals) // RANGES))
    for (sample, i, path), total in zip(manifest, totals, strict=True):
        if total <= size:
            ranges.append(Range(sample, i, path, ""))
            continue
        with storage.open_seekable(path) as raw:
            kind = kind_of(raw.read(_BGZF_HEAD))
        ranges.append(Range(sample, i, path, kind))
        if kind in SPLITTABLE:
            with _from_block(path, kind, 0, None) as text:
                fasta = text.read(PROBE).lstrip()[:1] == b">"
            probes += [{"file": len(ranges) - 1, "path": path, "kind": kind, "at": at, "until": min(at + size, total), "size": total, "fasta": fasta} for at in range(size, total, size)]
    found = _on_executors(spark, probes, lambda t: _place(t["path"], t["kind"], t["at"], t["until"], t["size"], t["fasta"]) or (None, None), "block long, skip long")
    cuts: dict[int, set[tuple[int, int]]] = {}
    for i, (block, skip) in found.items():
        if block is not None:
            cuts.setdefault(probes[i]["file"], set()).add((block, skip))
    out = []
    for n, r in enumerate(ranges):
        places = [(0, 0), *sorted(cuts.get(n, ()))]
        for j, (block, skip) in enumerate(places):
            end = places[j + 1] if j + 1 < len(places) else (None, 0)
            out.append(replace(r, block=block, skip=skip, end_block=end[0], end_skip=end[1], first=j << 40))
    return out


def _sizes(spark: SparkSession, ranges: Sequence[Range], enough: int | None) -> list[tuple[int, int]]:
    """(records, bases) of each range; counting stops when there are `enough` bases."""
    from kmerlake.sources.fastx import range_records

    def work(task: dict) -> tuple[int, int]:
        records = bases = 0
        for _, seq in range_records(Range(**task)):
            records, bases = records + 1, bases + len(seq)
            if enough is not None and bases >= enough:
                break
        return records, bases

    found = _on_executors(spark, [asdict(r) for r in ranges], work, "records long, bases long")
    return [found[i] for i in range(len(ranges))]


def numbered(spark: SparkSession, ranges: list[Range], through: bool = False) -> list[Range]:
    """Ranges whose numbers follow without gaps in a file, or `through` all files of a sample: where there are several ranges, their records are counted first."""
    of = (lambda r: r.sample) if through else (lambda r: (r.file_idx, r.path, r.sample))
    several = Counter(map(of, ranges))
    counted = [r for r in ranges if several[of(r)] > 1]
    sizes = dict(zip(counted, _sizes(spark, counted, None), strict=True))
    out, before = [], {}
    for r in ranges:
        key = of(r)
        out.append(replace(r, first=before.get(key, 0)))
        before[key] = before.get(key, 0) + (sizes[r][0] if r in sizes else 0)
    return out


def planned_limited(spark: SparkSession, manifest: Sequence[tuple[str, int, str]], size: int, limit: int) -> list[Range]:
    """plan and limited by files, 1, 2, 4 ... more of each sample at a time: those behind the limit are not opened, nor searched for ranges."""
    left: dict[str, list[tuple[str, int, str]]] = {}
    for m in manifest:
        left.setdefault(m[0], []).append(m)
    total, out, more = dict.fromkeys(left, 0), [], 1
    while left:
        out += limited(spark, plan(spark, [m for rest in left.values() for m in rest[:more]], size), limit, total)
        left = {s: rest[more:] for s, rest in left.items() if total[s] < limit and rest[more:]}
        more *= 2
    return out


def limited(spark: SparkSession, ranges: list[Range], limit: int, total: dict[str, int] | None = None) -> list[Range]:
    """The ranges of each sample up to where its records have `limit` bases; the last stops at the exact record.

    Ranges are counted in order, 1, 2, 4 ... more of each sample at a time until there are enough, so what is read
    follows the limit and not the input. total: the samples' bases in files before, to which these are added.
    """
    left: dict[str, list[Range]] = {}
    for r in ranges:
        left.setdefault(r.sample, []).append(r)
    total, out, more = dict.fromkeys(left, 0) if total is None else total, [], 1
    while left:
        wave = [r for rest in left.values() for r in rest[:more]]
        for r, (_, bases) in zip(wave, _sizes(spark, wave, max(limit, 1)), strict=True):
            if total[r.sample] < limit:
                out.append(replace(r, bases=limit - total[r.sample]))
                total[r.sample] += bases
        left = {s: rest[more:] for s, rest in left.items() if total[s] < limit and rest[more:]}
        more *= 2
    return sorted(out, key=ranges_order(ranges))


def ranges_order(ranges: Sequence[Range]):
    place = {(r.sample, r.file_idx, r.path, r.block, r.skip): i for i, r in enumerate(ranges)}
    return lambda r: place[r.sample, r.file_idx, r.path, r.block, r.skip]
