"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a new local folder only where that is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-kmerlake-", dir="/tmp")
    return _local[app]


def folder(spark: SparkSession, name: str = "") -> str:
    """A new folder's name; release() removes it."""
    own = f"{root(spark)}/kmerlake-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(own)
    return f"{own}/{name}" if name else own


def keep(df: DataFrame, name: str, notes: dict | None = None, **figures: Column) -> DataFrame:
    """df, written once and read from there: what made it does not run again, and a lost executor costs its own tasks only.

    figures: aggregates of df that are noted while it is written, without a job of their own, in `notes` if it is given.
    """
    path = folder(df.sparkSession, name)
    seen = Observation()
    out = df if notes is None else df.observe(seen, *(c.alias(n) for n, c in figures.items()))
    out.write.parquet(path)
    if notes is not None:
        notes |= seen.get
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the tables kept so far; results that have not been written or collected by then are lost."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
