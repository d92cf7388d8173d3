"""Long forms and orders of reports, for plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerlake.operators import sides

LEVEL = "containment"


def levels(report: DataFrame) -> dict[int, str]:
    """Depth threshold and column of each containment share that a report has, ascending."""
    rest = {c: c.removeprefix(LEVEL) for c in report.columns if c.startswith(LEVEL)}
    return dict(sorted((int(t), c) for c, t in rest.items() if t.isdecimal()))


def decay(report: DataFrame, ids: Sequence[str] = ("target", "sample")) -> DataFrame:
    """ids, threshold, containment: a row for each depth threshold of a report; values that are no numbers go."""
    by = levels(report)
    if len(by) < 2:
        raise ValueError(f"one depth threshold shows no decay; the report has {list(by)}")
    points = F.array(*(F.struct(F.lit(t).alias("threshold"), F.expr(f"try_cast(`{c}` AS DOUBLE)").alias("containment")) for t, c in by.items()))
    return report.select(*ids, F.inline(points)).filter(F.col("containment").isNotNull())


def first_appearance(df: DataFrame, column: str, order: str) -> DataFrame:
    """df with {column}_order: the rank of its values by where `order` first has them."""
    first = df.groupBy(column).agg(F.min(order).alias("_first"))
    # one row a distinct value
    ranked = first.withColumn(f"{column}_order", F.row_number().over(Window.orderBy("_first")) - 1).drop("_first")
    return df.join(sides.bounded(ranked), column)


def only_samples(report: DataFrame, samples: Sequence[str] | None = None, totals: bool = False) -> DataFrame:
    """Rows of the named samples: the TOTAL rows alone, or all but those."""
    is_total = F.col("target") == "TOTAL"
    kept = report.filter(is_total if totals else ~is_total)
    return kept.filter(F.col("sample").isin(list(samples))) if samples else kept
