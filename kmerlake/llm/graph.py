"""Connected components as Spark jobs: union-find inside each partition, then hooking and pointer jumping.

Every table is written to the shared folder, so a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.llm import scratch
from kmerlake.llm.workers import trimmed


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as (its smallest member, member) by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(lo), find(hi)
            parent[max(x, y)] = min(x, y)
    members = [x for x in parent if parent[x] != x]
    yield pa.RecordBatch.from_pydict({"lo": pa.array([find(x) for x in members], pa.int64()), "hi": pa.array(members, pa.int64())})


def _jumped(hooks: DataFrame) -> DataFrame:
    """hooks: node, parent (smaller). Points every node at its root."""
    while True:
        up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
        hooks = scratch.keep(hooks.join(up, "parent", "left").select("node", F.coalesce("_above", "parent").alias("parent"), F.col("_above").isNotNull().alias("_moved")), "hooks")
        done = hooks.filter("_moved").isEmpty()
        hooks = hooks.drop("_moved")
        if done:
            return hooks


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Gives node and root, its component's smallest node, for all nodes but the roots. Links to itself or null are none."""
    live = links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    live = scratch.keep(live.mapInArrow(trimmed(_local_forest), "lo long, hi long").distinct(), "links")
    forest = None
    while not live.isEmpty():
        hooks = _jumped(scratch.keep(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), "hooks"))
        if forest is None:
            forest = hooks.withColumnRenamed("parent", "root")
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("parent").alias("_above"))
            moved = forest.join(up, "root", "left").select("node", F.coalesce("_above", "root").alias("root"))
            forest = scratch.keep(moved.unionByName(hooks.withColumnRenamed("parent", "root")), "forest")
        for side in ("lo", "hi"):
            up = hooks.select(F.col("node").alias(side), F.col("parent").alias("_root"))
            other = "hi" if side == "lo" else "lo"
            live = live.join(up, side, "left").select(F.coalesce("_root", side).alias(side), other)
        live = scratch.keep(live.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).filter("lo < hi").distinct(), "links")
    return forest if forest is not None else live.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
