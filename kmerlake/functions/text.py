"""Numbers and names as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_UNITS = ((10**9, "G"), (10**6, "M"), (10**3, "K"))


def format_bp(n: Column) -> Column:
    """Bases with a unit: 1.5Gbp."""
    out = F.concat(n.cast("long").cast("string"), F.lit("bp"))
    for size, unit in reversed(_UNITS):
        out = F.when(n >= size, F.format_string(f"%.1f{unit}bp", n / F.lit(float(size)))).otherwise(out)
    return out


def format_bp_per_sec(rate: Column) -> Column:
    out = F.format_string("%.0f bp/s", rate.cast("double"))
    for size, unit in reversed(_UNITS):
        out = F.when(rate >= size, F.format_string(f"%.1f {unit}bp/s", rate / F.lit(float(size)))).otherwise(out)
    return out


def short_name(target: Column, totals_label: str | None = None) -> Column:
    """A target without what stands before its first space; TOTAL by another label, if there is one."""
    short = F.when(F.instr(target, " ") > 0, F.substring(target, F.instr(target, " ") + 1, F.length(target))).otherwise(target)
    return F.when(target == "TOTAL", F.lit(totals_label)).otherwise(short) if totals_label else short


def depth_label(median: Column) -> Column:
    return F.when(median > 0, F.format_string("med(abund): %.0f", F.bround(median.cast("double"), 0))).otherwise("")
