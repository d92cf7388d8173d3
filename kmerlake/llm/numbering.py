"""Running numbers within groups that no task holds whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.llm import scratch


def numbered(df: DataFrame, group: str, order: list[Column], at: str = "at", size: str = "size") -> DataFrame:
    """df with `at`, from 0 in each group (not null) by order, and `size`, the group's rows.

    Rows are sorted by ranges of (group, order), so a group may lie in many partitions; each range's share of
    a group is counted, and the counts before it (a row for each range that the group touches) are added.
    Equal rows are numbered in any order.
    """
    ranges = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    # the lower 33 bits of the id number a partition's rows as they are sorted
    ranges = ranges.withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranges = scratch.keep(ranges, "ranges")
    shares = ranges.groupBy("_range", group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = shares.select("_range", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias(size))
    return ranges.join(shares, ["_range", group]).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(at), size)
