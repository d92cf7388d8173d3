"""The driver's tables in the roles of the analyses: text becomes DNA letter by letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.functions.dna import text_as_dna

N_GROUPS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out if its files have fewer row groups than there are cores: what follows is work by row. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts(df: DataFrame, least: int) -> int:
    """Into how many parts to deal the table df: as many as Spark reads it in, so that none grows with it."""
    return max(least, df.rdd.getNumPartitions())


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_idx, target, seq: each benchmark item."""
    name = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("target_idx"), name.alias("target"), text_as_dna("text").alias("seq"))


def merged_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as the records of a few targets."""
    g = F.pmod("item_id", F.lit(N_GROUPS))
    return table(spark, sf_dir, "benchmark").select(g.alias("target_idx"), F.concat(F.lit("group"), g.cast("string")).alias("target"), F.lit(0).alias("file_idx"), F.col("item_id").alias("rec_idx"), text_as_dna("text").alias("seq"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_idx, seq"""
    return merged_targets(spark, sf_dir).select(F.col("target_idx").cast("int").alias("group_idx"), "seq")


def group_names(spark: SparkSession) -> DataFrame:
    return spark.range(N_GROUPS).select(F.col("id").cast("int").alias("group_idx"), F.concat(F.lit("group"), F.col("id").cast("string")).alias("group"))


def documents(spark: SparkSession, sf_dir: str, sample: str = "lang") -> DataFrame:
    """sample, seq_id, text: each document."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", sample, "text")).select(F.col(sample).alias("sample"), F.col("doc_id").alias("seq_id"), "text")


def reads(spark: SparkSession, sf_dir: str, sample: str = "lang") -> DataFrame:
    """sample, seq_id, seq: each document."""
    return documents(spark, sf_dir, sample).select("sample", "seq_id", text_as_dna("text").alias("seq"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, conv_id, turn, seq: each turn of a conversation."""
    return spread(table(spark, sf_dir, "conversations")).select(F.col("role").alias("sample"), "conv_id", "turn", text_as_dna("text").alias("seq"))
