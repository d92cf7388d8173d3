"""Reports as tab-separated text: the last mile, over rows that are few (targets by samples, or histogram lines)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlake.operators import classify, containment
from kmerlake.plans.params import normalise_thresholds

P_FLOOR = 1e-16


def ratio_text(x: float | None) -> str:
    return "-" if x is None else f"{x:.3f}"


def interval_text(lo: float | None, hi: float | None) -> str:
    return "-" if lo is None or hi is None else f"{lo:.3f}-{hi:.3f}"


def patchiness_text(z: float | None, p: float | None) -> str:
    """z|p for significant clustering only."""
    if z is None or p is None or math.isnan(z) or z <= 0 or p > 0.05:
        return "-"
    if p < P_FLOOR:
        return f"{z:.1f}|<1e-16"
    mantissa, exponent = f"{p:.0e}".split("e")
    return f"{z:.1f}|{mantissa}e{int(exponent)}"


def report_lines(result: DataFrame, thresholds: Sequence[int], confidence: bool = False, totals: bool = True, sort: str = "containment", samples: Sequence[str] | None = None) -> Iterator[str]:
    """result: operators.containment.containment()."""
    extra = normalise_thresholds(thresholds)
    rows = containment.with_totals(result, thresholds) if totals else result.withColumn("is_total", F.lit(False))
    head = ["target", "sample", "containment1", "containment1_hits"] + ["containment1_ci", "patchiness", "ani_est"] * confidence
    for t in extra:
        head += [f"containment{t}", f"containment{t}_hits"] + [f"containment{t}_ci"] * confidence
    head += ["median_nz_abundance", "target_kmers", "target_length", "sample_seqs", "sample_bases"]
    yield "\t".join(head)
    for r in rows.orderBy(*containment.report_order(sort, samples)).toLocalIterator():
        ci = lambda t: interval_text(r[f"containment{t}_lo"], r[f"containment{t}_hi"])  # noqa: B023, E731
        out = [r["target"], r["sample"], ratio_text(r["containment1"]), str(r["containment1_hits"])]
        out += [ci(1), patchiness_text(r["patchiness_z"], r["patchiness_p"]), ratio_text(r["ani_est"])] if confidence else []
        for t in extra:
            out += [ratio_text(r[f"containment{t}"]), str(r[f"containment{t}_hits"])] + ([ci(t)] if confidence else [])
        median = r["median_nz_abundance"]
        yield "\t".join([*out, "-" if median is None else f"{median:.0f}", *(str(r[c]) for c in head[-4:])])


def summary_lines(summary: DataFrame, samples: Sequence[str] | None = None) -> Iterator[str]:
    head = ["sample", "group", "seqs_pct", "seqs", "bases_pct", "bases"]
    yield "\t".join(head)
    for r in summary.orderBy(*classify.summary_order(samples)).toLocalIterator():
        yield "\t".join([r["sample"], r["group"], f"{r['seqs_pct']:.3f}", str(r["seqs"]), f"{r['bases_pct']:.3f}", str(r["bases"])])


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    """Per-read rows, dumped k-mers, histograms: written by the tasks, unordered between files."""
    df.write.option("sep", "\t").option("header", header).csv(path)


def read_reports(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Reports or histograms of several runs as one table; columns that one lacks are null."""
    frames = [spark.read.option("sep", "\t").option("header", True).csv(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
