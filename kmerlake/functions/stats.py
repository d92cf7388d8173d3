"""Statistical column expressions: intervals, tail probabilities, identity estimates, runs test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 95 % normal quantile.
Z95 = 1.959963984540054
# Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# When an estimate is made at all.
MIN_TARGET_KMERS = 50
MIN_NONZERO = 25
MIN_MODE_COUNT = 3
MAX_MEDIAN = 2.0
MIN_IDENTITY = 0.90
MIN_RUN_HITS = 10


def ratio(x: Column, n: Column) -> Column:
    """x / n, and 0 for nothing."""
    return F.when(n > 0, x / n).otherwise(F.lit(0.0))


def _clamped(p: Column) -> Column:
    """p within 0 and 1; null stays null, which greatest and least alone would skip."""
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def wilson(x: Column, n: Column) -> tuple[Column, Column]:
    """Wilson's 95 % interval for x of n; (0, 0) for n = 0."""
    m = F.when(n > 0, n).otherwise(F.lit(1)).cast("double")
    p = x / m
    spread = F.lit(Z95) * F.sqrt(p * (1 - p) / m + F.lit(Z95**2) / (4 * m * m))
    mid, scale = p + F.lit(Z95**2) / (2 * m), 1 + F.lit(Z95**2) / m
    lo, hi = F.greatest(F.lit(0.0), (mid - spread) / scale), F.least(F.lit(1.0), (mid + spread) / scale)
    return F.when(n > 0, lo).otherwise(F.lit(0.0)), F.when(n > 0, hi).otherwise(F.lit(0.0))


def erf(x: Column) -> Column:
    t = 1 / (1 + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    y = 1 - poly * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def normal_survival(x: Column) -> Column:
    return _clamped((1 - erf(x / F.sqrt(F.lit(2.0)))) / 2)


def poisson_tail(rate: Column, least: int) -> Column:
    """P(X >= least) for a Poisson count."""
    if least <= 0:
        return F.lit(1.0)
    term = below = F.exp(-rate)
    for i in range(1, least):
        term = term * rate / i
        below = below + term
    return _clamped(1 - below)


def depth_rate(target_kmers: Column, nonzero: Column, median: Column, mode: Column, at_mode: Column, after_mode: Column) -> Column:
    """Sequencing depth from the ratio of two neighbouring depth counts; null where too little is known."""
    known = (target_kmers >= MIN_TARGET_KMERS) & (median <= MAX_MEDIAN) & (nonzero >= MIN_NONZERO) & (at_mode >= MIN_MODE_COUNT) & (after_mode >= MIN_MODE_COUNT)
    return F.when(known, after_mode / at_mode * (mode + 1))


def identity(containment: Column, rate: Column, target_kmers: Column, k: int) -> Column:
    """Average nucleotide identity from containment, adjusted for depth where a rate is known."""
    seen = poisson_tail(rate, 1)
    adjusted = F.when(rate.isNotNull() & (seen > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), containment / seen))).otherwise(containment)
    estimate = F.pow(adjusted, F.lit(1.0 / k)) if k > 0 else F.lit(None).cast("double")
    return F.when((target_kmers >= MIN_TARGET_KMERS) & (containment > 0) & (estimate >= MIN_IDENTITY), estimate)


def runs_z(n: Column, hits: Column, runs: Column) -> Column:
    """Wald-Wolfowitz: positive if hits cluster. Null where too little is known."""
    h, n_ = hits.cast("double"), n.cast("double")
    m = n_ - h
    mean = 1 + 2 * h * m / n_
    var = 2 * h * m * (2 * h * m - n_) / (n_ * n_ * (n_ - 1))
    known = (n >= MIN_TARGET_KMERS) & (hits >= MIN_RUN_HITS) & (n - hits >= MIN_RUN_HITS)
    return F.when(known, F.when(var > 0, -(runs - mean) / F.sqrt(var)))
