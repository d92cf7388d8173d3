"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Texts become token counts once; only pieces and their lengths travel afterwards. Items shorter than a
sequence are dealt by hash into shards of about `shard_items`, so a task's work is bounded whatever the
input. Each shard is evolved on several islands (rows of one DataFrame); between the epochs the elites
migrate: a shuffle by shard brings every island the best plans of the others. Sequences of a shard that
stay under-filled give their items to the next level, where they meet those of other shards, until
one shard holds the rest.

Defined cases: a null or empty text is one piece with the end id alone; only documents longer than a
sequence are cut, the first piece takes what is over; repeated rows are packed each; other columns are
ignored; texts of any length are encoded whole; an empty table gives no rows. Every seed follows from level, shard and island: the same input
files give the same plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.llm import packing_ga, scratch, tokens
from kmerlake.llm.workers import trimmed

CAPACITY = 1024
SHARD_ITEMS = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
WELL_FILLED = 0.98  # sequences below this are opened again on the next level


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and `item`, a number of its own."""
    fields = ["item", "doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, item = tokens.encoder(vocabulary).encode_all, TaskContext.get().partitionId() << 33
        for batch in batches:
            for row, ids, of in encode_all(batch.column(1)):
                n = np.diff(of)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                # the first piece takes what is over
                end = n[doc] - capacity * (count[doc] - 1 - piece)
                start = np.where(piece == 0, 0, end - capacity)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((of[doc] + start).tolist(), (of[doc] + end).tolist(), strict=True)]
                names = batch.column(0).slice(row, len(n)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(item + np.arange(len(doc))), names, *(pa.array(x, pa.int64()) for x in (piece, start, end - start, crc))], fields)
                item += len(doc)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(cut), "item long, doc_id long, piece long, start long, length long, ids_crc32 long").withColumn("piece", F.col("piece").cast("int"))


def _islands(shards: DataFrame, level: int, epoch: int, capacity: int) -> DataFrame:
    """shards: shard, island, lengths (descending), plans (of the epoch before). Gives shard, island, plan, bins, squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                before = [np.array(p, np.int64) for p in row["plans"] or []]
                plan = packing_ga.evolve(lengths, capacity, [level, epoch, row["island"], row["shard"]], before, POPULATION, GENERATIONS)
                bins, squares = packing_ga.score(lengths, plan, capacity)
                yield pa.RecordBatch.from_pydict({"shard": [row["shard"]], "island": [row["island"]], "plan": pa.array([plan], pa.list_(pa.int64())), "bins": [-bins], "squares": [squares]})

    return shards.mapInArrow(trimmed(run), "shard long, island long, plan array<long>, bins long, squares double")


def pack_level(items: DataFrame, n_items: int, level: int, capacity: int) -> DataFrame:
    """items: item, length (at most capacity). Gives item, length, shard, bin, fill, place (ids before it in its bin)."""
    spark = items.sparkSession
    n_shards = max(1, round(n_items / SHARD_ITEMS))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_shards)).cast("long"))
    # bounded: about SHARD_ITEMS rows of two numbers each
    shards = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(F.col("length").alias("n"), "item")), asc=False).alias("own"))
    shards = scratch.keep(shards, f"packing-shards-{level}")
    split = shards.select("shard", F.transform("own", lambda x: x["n"]).alias("lengths"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(ISLANDS)))).alias("island"))
    # an island is a row; dealing the rows out is what makes islands run side by side
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    elites = None
    for epoch in range(EPOCHS):
        if elites is None:
            world = split.withColumn("plans", F.lit(None).cast("array<array<long>>"))
        else:
            world = split.join(elites.groupBy("shard").agg(F.collect_list("plan").alias("plans")), "shard")
        elites = _islands(world.select("shard", "island", "lengths", "plans").repartition(width, "shard", "island"), level, epoch, capacity)
        elites = scratch.keep(elites, f"packing-elites-{level}-{epoch}")
    best = elites.groupBy("shard").agg(F.max_by("plan", F.struct(-F.col("bins"), "squares", -F.col("island"))).alias("plan"))
    rows = shards.join(best, "shard").select("shard", F.inline(F.arrays_zip("own", "plan"))).select("shard", F.col("own.item").alias("item"), F.col("own.n").alias("length"), F.col("plan").alias("bin"))
    w = Window.partitionBy("shard", "bin")
    before = w.orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("fill", F.sum("length").over(w)).withColumn("place", F.coalesce(F.sum("length").over(before), F.lit(0)))


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found: pieces(), kept in files. Adds sequence_id and offset."""
    full = found.filter(F.col("length") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, level, placed = found.filter(F.col("length") < capacity).select("item", "length"), 0, [full]
    n = left.count()
    while n:
        packed = scratch.keep(pack_level(left, n, level, capacity), f"packed-{level}")
        # a level, a shard and a bin make a number: 7, 36 and 20 bits
        named = packed.select("item", "length", "fill", ((F.lit(level << 56) + F.col("shard") * (1 << 20)) + F.col("bin")).alias("sequence_id"), F.col("place").alias("offset"))
        more = named.filter(F.col("fill") < WELL_FILLED * capacity)
        rest = more.count() if n > SHARD_ITEMS else 0
        if not rest or rest > 0.8 * n:  # the last level
            placed.append(named.select("item", "sequence_id", "offset"))
            break
        placed.append(named.filter(F.col("fill") >= WELL_FILLED * capacity).select("item", "sequence_id", "offset"))
        left, n, level = more.select("item", "length"), rest, level + 1
    placements = placed[0]
    for p in placed[1:]:
        placements = placements.unionByName(p)
    return found.join(placements, "item").drop("item")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    found = scratch.keep(pieces(docs, vocabulary or tokens.default_vocabulary(), capacity), "pieces")
    return pack(found, capacity)
