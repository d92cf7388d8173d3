"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find.

1. One scan makes each document's distinct word shingles, a name of the set (its size and two sums) and a
   signature. Documents with equal sets are one class, named by its smallest doc_id.
2. Classes that share a band's hash are candidates. Never are all pairs of a bucket made: first each
   class is compared with the smallest of its bucket mates, then with the leaders of its other buckets
   that are in another component by then.
3. What is left are buckets whose members are still in several components. Their members are dealt into
   chunks, and tasks compare the odd sketches of two chunks at a time: a bit more in the difference of two
   sketches than a link allows elements in that of the sets rules a pair out for certain. Chunks that
   cannot hold a link do not meet: both of the bucket's largest component, or too unlike in size.
4. Every candidate is confirmed on the full shingle sets, and confirmed links go to union-find.

With 32 bands of four slots a link of exactly 0.75 has no shared band with probability 5e-6, and a
higher similarity far less; nothing else can lose a link.

Defined cases: without words (or text) a document has the empty set and no link; with fewer words than a
shingle the whole sequence is one; rows of one doc_id are one document, linked by any of its texts; rows
with a null doc_id have no link, a null component, and are kept; other columns are ignored or pass
through; texts of any length give all their shingles; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.llm import graph, scratch
from kmerlake.llm.shingles import bands, fingerprints, folded, odd_sketch, shingle_sets, signatures
from kmerlake.llm.textkit import blocks, words
from kmerlake.llm.workers import trimmed

PERCENT = 75
CHUNK_BYTES = 1 << 18  # of sketches, or so, that meet those of another chunk in one step


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, f1, f2, bands; neither name nor bands for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in blocks(batch.column(1)):
                h, _, _, of = words(data, at)
                x, of = shingle_sets(h, of)
                sig, n = signatures(x, of), np.diff(of)
                f1, f2 = fingerprints(x, of)
                keys, none = bands(sig).view(np.int64), n == 0
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), keys.shape[1]).cast(pa.list_(pa.int64()))
                ids = batch.column(0).slice(row, len(n))
                names = [pa.array(v.view(np.int64), mask=none) for v in (f1, f2)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *names, lists], ["doc_id", "n", "f1", "f2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, n long, f1 long, f2 long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """node, set: the shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in blocks(batch.column(1)):
                h, _, _, of = words(data, at)
                x, of = shingle_sets(h, of)
                sets = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(of) - 1), sets], ["node", "set"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "node long, set array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b. Those whose sets are similar enough. A leader of a third of all pairs is a skewed merge join, split at run time."""
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("_sb")).hint("merge"), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("set").alias("_sa")).hint("merge"), "a")
    common = F.size(F.array_intersect("_sa", "_sb"))
    return both.filter(100 * common >= percent * (F.size("_sa") + F.size("_sb") - common)).select("a", "b")


def _sketches(sets: DataFrame) -> DataFrame:
    """node, n, sketch"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.asarray(x.values, np.int64).view(np.uint64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([odd_sketch(x).tobytes() for x in own], pa.binary())], ["node", "n", "sketch"])

    return sets.mapInArrow(trimmed(run), "node long, n long, sketch binary")


def _by_width(members: pa.StructArray) -> dict[int, tuple[np.ndarray, ...]]:
    """node, root, n and sketch words of the members, by the width of their sketches."""
    node, root, n, sketch = (members.field(i) for i in range(4))
    at = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset : sketch.offset + len(sketch) + 1].astype(np.int64)
    data, size = np.frombuffer(sketch.buffers()[2], np.uint8), np.diff(at)
    out = {}
    for w in np.unique(size).tolist():
        own = np.flatnonzero(size == w)
        bits = np.stack([data[i : i + w] for i in at[own]]).view("<u8")
        out[w // 8] = (*(x.to_numpy()[own] for x in (node, root, n)), bits)
    return out


def _possible(x: pa.StructArray, y: pa.StructArray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of members of different components whose sizes and sketches allow a link."""
    right = _by_width(y)
    for w, (node, root, n, bits) in _by_width(x).items():
        for v, (node_, root_, n_, bits_) in right.items():
            a, b = folded(bits, min(v, w)), folded(bits_, min(v, w))
            for i in range(len(node)):
                # union + intersection = n + n_, and 100 * intersection >= percent * union
                most = (n[i] + n_) * (100 - percent) // (100 + percent)
                fits = np.flatnonzero((root_ != root[i]) & (abs(n[i] - n_) <= most))
                if len(fits):
                    fits = fits[np.bitwise_count(a[i] ^ b[fits]).sum(1, dtype=np.int64) <= most[fits]]
                    yield from ((min(int(node[i]), k), max(int(node[i]), k)) for k in node_[fits].tolist())


def _dealt(open_: DataFrame, percent: int) -> DataFrame:
    """open_: band, node, root, n of buckets with several components. Adds big, size and chunk.

    A bucket whose sketches fit in one chunk is one. Of a larger one the most frequent component (big) is
    apart, for its members need not meet each other, and so are sizes: a link's sets are in the same or in
    neighbouring classes of size. Each of these parts has as many chunks as its sketches fill.
    """
    weight = F.greatest("n", F.lit(128)).alias("_w")  # a sketch has fewer bytes
    counted = open_.groupBy("band", "root").agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    split = counted.groupBy("band").agg(F.count("*").alias("_roots"), F.sum("_w").alias("_all"), F.max(F.struct("_n", "root")).getField("root").alias("_big")).filter("_roots > 1")
    part = F.col("_all") > CHUNK_BYTES
    size = F.floor(F.log(F.col("n")) / math.log(100 / percent * 1.005)).cast("int")
    kinds = {"big": part & (F.col("root") == F.col("_big")), "size": F.when(part, size).otherwise(F.lit(0))}
    members = open_.join(split.hint("merge"), "band").withColumns(kinds).drop("_roots", "_all", "_big")
    parts = members.groupBy("band", "big", "size").agg(F.ceil(F.sum(weight) / CHUNK_BYTES).cast("int").alias("chunks"))
    # parts are counted map-side, so a bucket of any size is a few rows on this side
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    return members.join(parts.hint("merge"), ["band", "big", "size"]).withColumn("chunk", chunk)


def _meetings(dealt: DataFrame) -> DataFrame:
    """band, big, size, chunk and the big_, size_, chunk_ to meet: each two chunks that can hold a link once, none both of the big component."""
    parts = dealt.select("band", "big", "size", "chunks").distinct()
    other = parts.select("band", F.col("big").alias("big_"), F.col("size").alias("size_"), F.col("chunks").alias("chunks_"))
    near = F.col("size_") - F.col("size")
    wanted = F.when(F.col("big_"), F.abs(near) <= 1).otherwise(near.isin(0, 1))
    from_ = F.when(F.col("big_") | (near > 0), F.lit(0)).otherwise(F.col("chunk"))
    left = dealt.filter("NOT big").select("band", "big", "size", "chunk").join(other.hint("merge"), "band").filter(wanted)
    return left.select("band", "big", "size", "chunk", "big_", "size_", F.explode(F.sequence(from_, F.col("chunks_") - 1)).alias("chunk_"))


def _across(mates: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: possible links of nodes that share a band but not yet a component. mates: band, node, n."""
    open_ = scratch.keep(_root(mates, roots, "node", "root"), "open-mates")
    members = _dealt(open_, percent).join(_sketches(sets).drop("n").hint("merge"), "node")
    # about CHUNK_BYTES each, whatever the bucket's size
    key = ["band", "big", "size", "chunk"]
    dealt = members.groupBy(*key, "chunks").agg(F.collect_list(F.struct("node", "root", "n", "sketch")).alias("x"))
    dealt = scratch.keep(dealt, "open-chunks")
    left = _meetings(dealt).join(dealt.select(*key, "x").hint("merge"), key)
    right = dealt.select("band", *(F.col(c).alias(f"{c}_") for c in key[1:]), F.col("x").alias("y"))
    met = left.join(right.hint("merge"), ["band", "big_", "size_", "chunk_"]).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                found.update(_possible(x.values, y.values, percent))
                if len(found) > 100_000:
                    yield _pairs(found)
                    found = set()
        yield _pairs(found)

    return met.mapInArrow(trimmed(run), "a long, b long").distinct()


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    at = sorted(found)
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in at], pa.int64()) for i in (0, 1)], ["a", "b"])


def _merged(links: DataFrame) -> DataFrame:
    """node, root for all nodes of links but the roots."""
    return scratch.keep(graph.components(links), "roots")


def _root(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    up = roots.select(F.col("node").alias(column), F.col("root").alias("_up"))
    return df.join(up, column, "left").withColumn(name, F.coalesce("_up", column)).drop("_up")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id of the component) and kept."""
    signed = scratch.keep(_signed(docs), "signatures")
    named = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"))
    classes = scratch.keep(classes, "classes")
    member = signed.select("doc_id", "n", "f1", "f2").join(classes.select("f1", "f2", "n", "node").hint("merge"), ["f1", "f2", "n"], "left")
    node = F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")
    member = scratch.keep(member.select("doc_id", "n", node), "members")

    bucket = classes.select(F.explode("bands").alias("band"), "node", "n")
    leaders = bucket.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).filter("leader < _last").drop("_last")
    mates = scratch.keep(bucket.join(leaders.hint("merge"), "band"), "bucket-mates")

    # rows of one doc_id with several sets tie those together
    own = member.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_last")).filter("a < _last")
    tied = member.join(own.select("doc_id", "a"), "doc_id").filter("node > a").select("a", F.col("node").alias("b"))

    ids = mates.select(F.col("node").alias("doc_id")).distinct()
    sets = scratch.keep(_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")), "shingle-sets")
    stars = scratch.keep(mates.filter("leader < node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")

    first = stars.groupBy("b").agg(F.min("a").alias("a"))
    links = scratch.keep(_confirmed(first, sets, percent).unionByName(tied), "links")
    roots = _merged(links)
    more = _root(_root(stars.join(first, ["a", "b"], "left_anti"), roots, "a", "ra"), roots, "b", "rb").filter("ra <> rb").select("a", "b")
    links = links.unionByName(scratch.keep(_confirmed(more, sets, percent), "links"))
    roots = _merged(links)

    across = _across(mates.select("band", "node", "n"), roots, sets, percent).join(stars, ["a", "b"], "left_anti")  # stars were tried
    links = links.unionByName(scratch.keep(_confirmed(across, sets, percent), "links"))
    roots = _merged(links)

    found = _root(member, roots, "node", "component_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that are not the smallest of their component."""
    gone = scratch.keep(near_duplicates(docs, percent).filter("NOT kept").select(F.col("doc_id").alias("_kml_gone")).distinct(), "near-duplicates")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_kml_gone"], "left_anti")
