"""Join sides whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerlake.sources import shared

BROADCAST_ROWS = 2_000_000


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df, computed once, and its number of rows, which is in the files' footers."""
    df = shared.keep(df, "side")
    return df, df.count()


def sized(df: DataFrame, of: DataFrame) -> tuple[DataFrame, int]:
    """df and a bound of its rows, where it has no more than `of`, which lies in files: if those are few enough to broadcast, df need not be computed to know."""
    most = of.count()
    return (df, most) if most <= BROADCAST_ROWS else counted(df)


def bounded(df: DataFrame, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """df, broadcast if it has at most `limit` rows (BROADCAST_ROWS); a larger one is joined by a shuffle. rows: its number, where known."""
    if rows is None:
        df, rows = counted(df)
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if limit is None else limit) else df.hint("shuffle_hash")
