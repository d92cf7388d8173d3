"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a fresh local folder only where that is unset (tests)."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-kmerlake-", dir="/tmp")
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/kmerlake-{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df once and go on from the files: lineage ends here, and a lost executor costs no recomputation."""
    path = path or new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
