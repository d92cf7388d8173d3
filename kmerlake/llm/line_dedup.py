"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

The state is three tables: `postings` (key, hash, doc_id: which document holds which line), `references`
(key, hash, refs, owner, last: how many rows hold it, the smallest and the largest document) and `filters`
(shard, buckets: a cuckoo filter of the keys that several documents share; a shard without any has an
empty one). Documents can be inserted and deleted; deleting the owner of a line hands it to the next
document, and a line that one document alone still holds leaves its filter. A filter that runs full is
built anew from the references, and all are, with more shards, when the shared keys have doubled.

A line's key is its text without white space at both ends, A-Z lower-cased; keys of under MIN_LENGTH code
points never count. To drop lines, each shard's postings, in chunks of about CHUNK_POSTINGS, meet the
shard's filter; what it has goes on to the exact join with `references`.

Defined cases: null or empty text is one empty line; rows with a null doc_id hold no line and keep all;
rows of one doc_id are one document; very long texts are split whole; other columns pass through; an
empty table gives an empty state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerlake.llm import scratch
from kmerlake.llm.columns import add_columns
from kmerlake.llm.cuckoo import CuckooFilter
from kmerlake.llm.workers import trimmed

MIN_LENGTH = 10
SHARD_KEYS = 40_000
CHUNK_POSTINGS = 50_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACES = bytes([0x20, *range(0x09, 0x0E)])


def line_keys(text: str | None) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys, None for those that never count."""
    lines = (text or "").encode().split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        k = line.strip(_SPACES).translate(_FOLD)
        # a byte of 10xxxxxx goes on with a code point
        long = len(k) >= MIN_LENGTH and (len(k) >= 4 * MIN_LENGTH or len(k.decode()) >= MIN_LENGTH)
        keys.append(hashlib.blake2b(k, digest_size=16).digest() if long else None)
    return lines, keys


def _shard(n_shards: int) -> Column:
    """From the hash's middle bits: bucket numbers use the low ones and fingerprints the high ones."""
    return (F.shiftrightunsigned("hash", 20).bitwiseAND(F.lit(0xFFFFFF)) % F.lit(n_shards)).alias("shard")


def postings(docs: DataFrame) -> DataFrame:
    """key, hash (its first half), doc_id: each line key once per row that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = {k for k in line_keys(text.as_py())[1] if k}
                keys += own
                ids += [doc] * len(own)
            hashes = np.frombuffer(b"".join(k[:8] for k in keys), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes), pa.array(ids, pa.int64())], ["key", "hash", "doc_id"])

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "key binary, hash long, doc_id long")


def references(found: DataFrame) -> DataFrame:
    return found.groupBy("key", "hash").agg(F.count("*").alias("refs"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))


SHARED = "owner < last"
FILTERS = "shard long, n_shards long, buckets binary"


def _built(shared: DataFrame, shards: DataFrame, n_shards: int) -> DataFrame:
    """The filters of some shards from their keys. shards: shard."""

    def build(own: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        hashes = np.unique(keys["hash"].to_numpy(np.int64)).view(np.uint64)
        return pd.DataFrame({"shard": own["shard"].iloc[:1], "n_shards": n_shards, "buckets": [CuckooFilter.of(hashes).to_bytes()]})

    keyed = shared.select("hash", _shard(n_shards)).join(shards, "shard", "left_semi")
    return shards.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(build, FILTERS)


def build_filters(refs: DataFrame) -> DataFrame:
    """shard, n_shards, buckets: one cuckoo filter for every SHARD_KEYS shared keys or so."""
    shared = refs.filter(SHARED)
    n_shards = max(1, -(-shared.count() // SHARD_KEYS))
    return _built(shared, refs.sparkSession.range(n_shards).select(F.col("id").alias("shard")), n_shards)


@dataclass
class LineIndex:
    postings: DataFrame
    references: DataFrame
    filters: DataFrame


def build_index(docs: DataFrame) -> LineIndex:
    found = scratch.keep(postings(docs), "line-postings")
    refs = scratch.keep(references(found), "line-references")
    return LineIndex(found, refs, scratch.keep(build_filters(refs), "line-filters"))


def _update_filters(index: LineIndex, refs: DataFrame, changed: DataFrame) -> DataFrame:
    """The index's filters for refs. changed: hash, before, after (whether its key was and is shared)."""
    n_shards = index.filters.select("n_shards").first()[0]
    if refs.filter(SHARED).count() > 2 * SHARD_KEYS * n_shards:
        return build_filters(refs)

    def update(old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.from_bytes(old["buckets"].iloc[0])
        gone, new = (moved.loc[which, "hash"].to_numpy(np.int64).view(np.uint64) for which in (moved["before"] & ~moved["after"], ~moved["before"] & moved["after"]))
        for k in gone:
            made.delete(k)
        full = not all(made.insert(k) for k in new)
        return pd.DataFrame({"shard": old["shard"].iloc[:1], "n_shards": n_shards, "buckets": [None if full else made.to_bytes()]})

    moved = changed.filter("before <> after").select("hash", "before", "after", _shard(n_shards))
    updated = scratch.keep(index.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(update, FILTERS), "line-filters-updated")
    full = updated.filter("buckets IS NULL").select("shard")
    return updated.filter("buckets IS NOT NULL").unionByName(_built(refs.filter(SHARED), full, n_shards))


def _changed(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """touched: hash, once each. A filter holds a hash as long as any of its keys is shared, so all keys of those hashes count."""
    b, a = (x.join(touched, "hash", "left_semi").groupBy("hash").agg(F.bool_or(F.expr(SHARED)).alias(name)) for x, name in ((before, "before"), (after, "after")))
    either = b.join(a, "hash", "full")
    return either.select("hash", F.coalesce("before", F.lit(False)).alias("before"), F.coalesce("after", F.lit(False)).alias("after"))


def insert_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    new = scratch.keep(postings(docs), "line-postings-new")
    both = index.references.unionByName(references(new))
    refs = both.groupBy("key", "hash").agg(F.sum("refs").alias("refs"), F.min("owner").alias("owner"), F.max("last").alias("last"))
    refs = scratch.keep(refs, "line-references")
    changed = _changed(index.references, refs, new.select("hash").distinct())
    filters = scratch.keep(_update_filters(index, refs, changed), "line-filters")
    return LineIndex(scratch.keep(index.postings.unionByName(new), "line-postings"), refs, filters)


def delete_documents(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """doc_ids: doc_id of the documents that go. A key goes when its count comes to nothing; its owner is looked for again only if it was deleted."""
    ids = doc_ids.select(F.col("doc_id").cast("long")).distinct()
    gone = index.postings.join(ids, "doc_id", "left_semi").groupBy("key").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
    gone = scratch.keep(gone, "line-references-gone")
    left = scratch.keep(index.postings.join(ids, "doc_id", "left_anti").select("key", "hash", "doc_id"), "line-postings")
    old = index.references.join(gone, "key")
    still = old.filter("refs > _n")
    kept = still.filter("owner < _lo AND last > _hi").select("key", "hash", (F.col("refs") - F.col("_n")).alias("refs"), "owner", "last")
    again = references(left.join(still.filter("owner >= _lo OR last <= _hi").select("key"), "key", "left_semi"))
    after = scratch.keep(kept.unionByName(again), "line-references-touched")
    refs = scratch.keep(index.references.join(gone, "key", "left_anti").unionByName(after), "line-references")
    filters = scratch.keep(_update_filters(index, refs, _changed(index.references, refs, old.select("hash").distinct())), "line-filters")
    return LineIndex(left, refs, filters)


def _maybe_shared(index: LineIndex) -> DataFrame:
    """key and doc_id of the postings whose key their shard's filter has."""
    row = index.filters.select("n_shards").first()
    found = index.postings.select("key", "hash", "doc_id", _shard(row[0]))
    # one row a shard
    chunks = scratch.keep(found.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK_POSTINGS).alias("chunks")), "line-chunks")
    dealt = found.join(chunks, "shard").select("key", "hash", "doc_id", "shard", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).alias("chunk"))
    filters = index.filters.join(chunks, "shard").select("shard", "buckets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))

    def probe(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        hit = CuckooFilter.from_bytes(held["buckets"].iloc[0]).contains(own["hash"].to_numpy(np.int64).view(np.uint64))
        return own.loc[hit, ["key", "doc_id"]]

    return dealt.groupBy("shard", "chunk").cogroup(filters.groupBy("shard", "chunk")).applyInPandas(probe, "key binary, doc_id long")


def dropped(index: LineIndex) -> DataFrame:
    """doc_id, keys: what each document loses. A key that a third of all documents hold is a skewed sort-merge join, split at run time."""
    exact = index.references.filter(SHARED).select("key", "owner")
    lost = _maybe_shared(index).join(exact.hint("merge"), "key").filter("owner < doc_id")
    return lost.groupBy(F.col("doc_id").alias("_kml_doc")).agg(F.collect_set("key").alias("_kml_lost"))


ADDED = T.StructType([T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def dedup_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """docs and kept_text, n_lines (before), n_dropped. The index is built of docs unless it is given."""
    index = index or build_index(docs)
    lost = scratch.keep(dropped(index), "line-drops")

    def cut(texts: pa.Array, lost_keys: pa.Array) -> list[pa.Array]:
        kept, n, gone = [], [], []
        for text, own in zip(texts, lost_keys.to_pylist(), strict=True):
            t = text.as_py() or ""
            if not own:
                kept.append(t)
                n.append(t.count("\n") + 1)
                gone.append(0)
                continue
            lines, keys = line_keys(t)
            own = set(own)
            stay = [x for x, k in zip(lines, keys, strict=True) if k not in own]
            kept.append(b"\n".join(stay).decode())
            n.append(len(lines))
            gone.append(len(lines) - len(stay))
        return [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())]

    joined = docs.filter("doc_id IS NOT NULL").join(lost, docs["doc_id"].cast("long") == lost["_kml_doc"], "left").drop("_kml_doc")
    rest = docs.filter("doc_id IS NULL").withColumn("_kml_lost", F.lit(None).cast("array<binary>"))
    return add_columns(joined.union(rest), ["text", "_kml_lost"], ADDED, cut, drop=("_kml_lost",))
