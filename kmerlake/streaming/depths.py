"""Depth counts of a stream as a stateful processor: saturating counts that expire by sample, and output that a restart repeats exactly.

The state is held by sample and shard of the k-mers, so a sample of any share of the reads is spread over `shards` tasks; each
holds its counts as one Arrow table, bounded by the shard's target k-mers. Hits are counted by Arrow batch before they
are shuffled. A micro-batch puts out the counts that it changed.

With event times, every shard is told of a batch's times of each sample, so all shards of a sample open and close
together: when the watermark is `idle` past the sample's last hit, its counts are put out once more as closed and forgotten. No
hit is dropped for being late: one of a closed sample opens it anew, with another `opened`.

Defined cases: a null sample is a sample of its own; a null time leaves its hits counted without moving the sample's end;
reads without a target k-mer change nothing; depths stay at MAX_DEPTH once there, and are put out no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from kmerlake.operators import sides
from kmerlake.operators.syncmers import syncmers
from kmerlake.operators.targets import union_kmers
from kmerlake.plans.params import MAX_DEPTH

SHARDS = 16
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEVER = -(1 << 62)


def _packed(counts: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, counts.schema) as out:
        out.write_table(counts)
    return sink.getvalue().to_pybytes()


def added(counts: pa.Table | None, more: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(counts, changed): kmer and depth after `more` (kmer, n) came to them, all and those that differ from before."""
    parts = [pa.table({"kmer": more["kmer"], "depth": pa.array([0] * len(more), pa.int64()), "n": more["n"]})]
    if counts is not None:
        parts.append(counts.append_column("n", pa.array([0] * len(counts), pa.int64())))
    both = pa.concat_tables(parts).group_by("kmer").aggregate([("depth", "sum"), ("n", "sum")])
    depth = pc.min_element_wise(pc.add(both["depth_sum"], both["n_sum"]), pa.scalar(MAX_DEPTH, pa.int64()))
    now = pa.table({"kmer": both["kmer"], "depth": depth})
    return now, now.filter(pc.not_equal(depth, both["depth_sum"]))


class DepthProcessor(StatefulProcessor):
    """Rows sample, shard, kmer, n, first, last to sample, kmer, depth, opened, closed. Rows of n = 0 tell times only (ms)."""

    def __init__(self, kmer: pa.DataType, idle_ms: int | None) -> None:
        self.kmer, self.idle_ms = kmer, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counts", "counts binary, opened bigint, last bigint")

    def _out(self, key: Any, counts: pa.Table, opened: int, closed: bool) -> pd.DataFrame:
        kmer = counts["kmer"].to_pandas()
        return pd.DataFrame({"sample": pd.Series([key[0]] * len(kmer), dtype=object), "kmer": kmer, "depth": counts["depth"].to_pandas(), "opened": opened, "closed": closed})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        counts = pa.ipc.open_stream(held[0]).read_all() if held else None
        opened, last = (held[1], held[2]) if held else (-_NEVER, _NEVER)
        before, first, parts = last, -_NEVER, []
        for r in rows:
            first, last = min(first, int(r["first"].min())), max(last, int(r["last"].max()))
            hits = r[r["n"] > 0]
            parts.append(pa.table({"kmer": pa.array(hits["kmer"], self.kmer), "n": pa.array(hits["n"], pa.int64())}))
        opened = opened if held else first
        counts, changed = added(counts, pa.concat_tables(parts))
        self.state.update((_packed(counts), opened, last))
        if self.idle_ms is not None and last > before:
            if before != _NEVER:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(last + self.idle_ms)
        yield self._out(key, changed, opened, False)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts, opened, _ = self.state.get()
        self.state.clear()
        yield self._out(key, pa.ipc.open_stream(counts).read_all(), opened, True)


def _counted(hits: DataFrame, shards: int, told: bool) -> DataFrame:
    """sample, shard, kmer, n, first and last: hits (sample, shard, kmer, at) counted by Arrow batch, and, if `told`, a row of n = 0 for each sample and shard."""
    fields = [hits.schema["sample"], T.StructField("shard", T.LongType()), hits.schema["kmer"], *(T.StructField(c, T.LongType()) for c in ("n", "first", "last"))]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            n = table.group_by(["sample", "shard", "kmer"]).aggregate([([], "count_all")])
            empty = [pa.array([x] * len(n), pa.int64()) for x in (-_NEVER, _NEVER)]
            out = pa.table([n["sample"], n["shard"], n["kmer"], n["count_all"], *empty], names)
            yield from out.to_batches()
            if told:
                times = table.group_by("sample").aggregate([("at", "min"), ("at", "max"), ("kmer", "min")])
                times = times.filter(pc.is_valid(times["at_min"]))
                each = pa.array([i for i in range(len(times)) for _ in range(shards)], pa.int64())
                times = times.take(each)
                own = pa.array(list(range(shards)) * (len(times) // shards), pa.int64())
                yield from pa.table([times["sample"], own, times["kmer_min"], pa.array([0] * len(times), pa.int64()), times["at_min"], times["at_max"]], names).to_batches()

    return hits.select("sample", "shard", "kmer", "at").mapInArrow(run, T.StructType(fields))


def depth_updates(reads: DataFrame, tk: DataFrame, k: int, s: int, order: str | None = None, time: str | None = None, late: str = "0 seconds", idle_ms: int | None = None, shards: int = SHARDS) -> DataFrame:
    """sample, kmer, depth, opened, closed: the counts that each micro-batch changed, in `update` mode.

    reads: a streaming sample, seq and, if `time` names one, a timestamp; then counts of a sample close idle_ms after its last
    hit by a watermark that is `late` behind. opened is the time of the sample's first hits, null without times.
    """
    if (time is None) != (idle_ms is None):
        raise ValueError("time and idle_ms go together")
    at = F.lit(None).cast("long") if time is None else F.unix_millis(time)
    found = syncmers(reads.select("sample", at.alias("at"), "seq"), k, s, order=order)
    hits = found.join(sides.bounded(union_kmers(tk)), "kmer", "left_semi").withColumn("shard", F.pmod(F.xxhash64("kmer"), F.lit(shards)))
    counted = _counted(hits, shards, time is not None)
    if time is not None:
        # the time column goes, so that no row counts as late
        moved = F.when(F.col("n") == 0, F.timestamp_millis("last"))
        counted = counted.withColumn("_kml_time", moved).withWatermark("_kml_time", late).drop("_kml_time")
    kmer = hits.schema["kmer"]
    arrow = pa.int64() if isinstance(kmer.dataType, T.LongType) else pa.decimal128(38, 0)
    schema = T.StructType([hits.schema["sample"], kmer, T.StructField("depth", T.LongType()), T.StructField("opened", T.LongType()), T.StructField("closed", T.BooleanType())])
    out = counted.groupBy("sample", "shard").transformWithStateInPandas(DepthProcessor(arrow, idle_ms), schema, "Update", "None" if time is None else "EventTime")
    return out.withColumn("opened", F.when(F.abs("opened") < -_NEVER, F.timestamp_millis("opened")))


def start(updates: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own under `path`; one that a restart repeats replaces what it left, so each counts once."""
    spark = updates.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # processors need it; the query keeps what is set when it starts
    try:
        write = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
        return write.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """sample, kmer, depth, opened, closed as they stand after the micro-batches written so far: within one opening depths only grow."""
    rows = spark.read.schema(schema).parquet(f"{path}/batch=*")
    return rows.groupBy("sample", "opened", "kmer").agg(F.max("depth").alias("depth"), F.max("closed").alias("closed")).select("sample", "kmer", "depth", "opened", "closed")
