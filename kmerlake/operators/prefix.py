"""Running sums of lengths over records in order, by blocks: no task ever holds a sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.operators import sides

RECORDS = 1 << 16  # to a block: neighbours by the last column of the order
BLOCK, BEFORE, TOTAL = "_block", "_block_before", "_block_total"


def with_block_sums(records: DataFrame, by: str, order: Sequence[str], size: Column | None = None) -> DataFrame:
    """records and their block, the bases of the group's blocks before it and its own. The last column of order is an integer. size: of a record, by default its sequence's."""
    size = F.length("seq") if size is None else size
    dealt = records.withColumn(BLOCK, F.floor(F.col(order[-1]) / RECORDS))
    keys = [by, *order[:-1], BLOCK]
    sums = dealt.groupBy(*keys).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias(TOTAL))
    # a row for each RECORDS records
    w = Window.partitionBy(by).orderBy(*order[:-1], BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(BEFORE, F.coalesce(F.sum(TOTAL).over(w), F.lit(0)).cast("long"))
    named = sides.bounded(sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), BEFORE, TOTAL))
    same = [dealt[k].eqNullSafe(named[f"_k{i}"]) for i, k in enumerate(keys)]
    return dealt.join(named, same).drop(*(f"_k{i}" for i in range(len(keys))))


def numbered(df: DataFrame, by: str, at: str, stretch: int) -> DataFrame:
    """df, i (from 1 by the integer `at`, in each group) and n, the group's rows.

    Rows are numbered in stretches of `at`, and each stretch's number of rows is added to those behind it: no task holds a group.
    """
    cut = df.withColumn(BLOCK, F.floor(F.col(at) / stretch))
    whole = Window.partitionBy(by)
    counts = cut.groupBy(by, BLOCK).agg(F.count("*").alias("_own"))
    before = F.coalesce(F.sum("_own").over(whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(by).alias("_k0"), F.col(BLOCK).alias("_k1"), before.alias(BEFORE), F.sum("_own").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy(by, BLOCK).orderBy(at))
    placed = cut.withColumn("_i", inside)
    placed = placed.join(counts, placed[by].eqNullSafe(counts["_k0"]) & placed[BLOCK].eqNullSafe(counts["_k1"]))
    return placed.select(*df.columns, (F.col("_i") + F.col(BEFORE)).cast("long").alias("i"), "n")
