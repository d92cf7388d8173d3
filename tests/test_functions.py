import math

import pytest
from pyspark.sql import functions as F

from kmerlake.functions import dna, stats, text
from kmerlake.plans import params
from kmerlake.sources import tsv


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_wilson_interval(spark):
    def interval(x, n):
        lo, hi = stats.wilson(F.lit(x), F.lit(n))
        return value(spark, lo), value(spark, hi)

    lo, hi = interval(8, 10)
    assert lo == pytest.approx(0.4901, abs=1e-4) and hi == pytest.approx(0.9433, abs=1e-4)
    assert interval(0, 0) == (0.0, 0.0)
    assert interval(0, 20)[0] == 0 and interval(0, 20)[1] > 0
    assert interval(20, 20)[1] == 1 and interval(20, 20)[0] < 1
    narrow, wide = interval(900, 1000), interval(9, 10)
    assert narrow[1] - narrow[0] < wide[1] - wide[0]
    assert all(a <= 0.9 <= b for a, b in (narrow, wide))


@pytest.mark.parametrize("x", [-3.0, -1.0, 0.0, 0.5, 1.96, 4.0, 9.0])
def test_survival(spark, x):
    assert value(spark, stats.normal_survival(F.lit(x))) == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), abs=1e-4)


@pytest.mark.parametrize("rate", [0.1, 1.0, 3.5])
@pytest.mark.parametrize("least", [1, 2, 5])
def test_poisson_tail(spark, rate, least):
    want = 1 - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(least))
    assert value(spark, stats.poisson_tail(F.lit(rate), least)) == pytest.approx(want, abs=1e-12)


def runs(spark, labels):
    turns = 1 + sum(a != b for a, b in zip(labels, labels[1:], strict=False))
    z = value(spark, stats.runs_z(F.lit(len(labels)), F.lit(sum(labels)), F.lit(turns)))
    return z, None if z is None else value(spark, stats.normal_survival(F.lit(z)))


def test_runs(spark):
    z, p = runs(spark, [True] * 50 + [False] * 50)
    assert z > 0 and p < 0.001
    z, p = runs(spark, [True, False] * 50)
    assert z < 0 and p > 0.999
    assert runs(spark, [True] * 5 + [False] * 95) == (None, None)
    assert runs(spark, [True] * 15 + [False] * 15) == (None, None)


def test_identity(spark):
    none = F.lit(None).cast("double")
    assert value(spark, stats.identity(F.lit(0.5), none, F.lit(100), 31)) == pytest.approx(0.5 ** (1 / 31))
    assert value(spark, stats.identity(F.lit(0.5), F.lit(1.0), F.lit(100), 31)) == pytest.approx((0.5 / (1 - math.exp(-1))) ** (1 / 31))
    assert value(spark, stats.identity(F.lit(0.5), none, F.lit(49), 31)) is None
    assert value(spark, stats.identity(F.lit(0.0), none, F.lit(100), 31)) is None
    assert value(spark, stats.identity(F.lit(0.001), none, F.lit(100), 31)) is None


def test_depth_rate(spark):
    rate = lambda *x: value(spark, stats.depth_rate(*(F.lit(v) for v in x)))
    assert rate(100, 60, 1.0, 1, 40, 10) == pytest.approx(10 / 40 * 2)
    assert rate(49, 40, 1.0, 1, 30, 10) is None
    assert rate(100, 60, 2.5, 1, 40, 10) is None
    assert rate(100, 24, 1.0, 1, 20, 4) is None
    assert rate(100, 60, 1.0, 1, 40, 2) is None


def test_formats(spark):
    for n, want in ((500, "500bp"), (1500, "1.5Kbp"), (1_500_000, "1.5Mbp"), (1_500_000_000, "1.5Gbp")):
        assert value(spark, text.format_bp(F.lit(n))) == want
        assert value(spark, text.format_bp_per_sec(F.lit(float(n)))) == want.replace("bp", " bp/s") if n < 1000 else True
    assert value(spark, text.format_bp_per_sec(F.lit(1500.0))) == "1.5 Kbp/s"
    assert tsv.patchiness_text(3.0, 0.001) == "3.0|1e-3"
    assert tsv.patchiness_text(9.0, 0.0) == "9.0|<1e-16"
    assert tsv.patchiness_text(-1.0, 0.9) == tsv.patchiness_text(1.0, 0.2) == tsv.patchiness_text(None, None) == "-"
    assert tsv.interval_text(0.4901, 0.9433) == "0.490-0.943" and tsv.ratio_text(None) == "-"
    assert value(spark, text.short_name(F.lit("NC_1.2 a virus"))) == "a virus"
    assert value(spark, text.short_name(F.lit("TOTAL"), "all")) == "all"


def test_dna(spark):
    assert value(spark, dna.revcomp(F.lit("AACGT"))) == "ACGTT"
    assert value(spark, dna.decode(F.lit(0b00_01_10_11), 5)) == "AACGT"
    assert value(spark, dna.is_unambiguous(F.lit("ACGT\n"))) is False
    assert value(spark, dna.text_as_dna(F.lit("Abé z"))) == "ACéGC"


def test_params():
    for k, s in ((4, 3), (31, 8), (9, 9), (63, 9), (1, 1), (61, 33)):
        with pytest.raises(ValueError):
            params.check_k_s(k, s)
    params.check_k_s(61, 31)
    for f in (0, -1, 1.5, float("nan")):
        with pytest.raises(ValueError):
            params.check_fraction(f)
    assert params.normalise_thresholds([100, 1, 10, 10, 0]) == [10, 100]
    with pytest.raises(ValueError):
        params.normalise_thresholds([65536])
    assert [params.parse_bases(x) for x in ("12", "3k", "2M", "1g", "1T")] == [12, 3000, 2_000_000, 10**9, 10**12]
    with pytest.raises(ValueError):
        params.parse_bases("1.5M")
    with pytest.raises(ValueError, match="Duplicate"):
        params.check_sample_names(["a", "a"])
    with pytest.raises(ValueError, match="Too many groups"):
        params.check_groups(129)


def test_halves_of_depth_labels_go_to_even(spark):
    assert [value(spark, text.depth_label(F.lit(x))) for x in (0.0, 0.5, 1.5, 2.5, 3.5)] == ["", "med(abund): 0", "med(abund): 2", "med(abund): 2", "med(abund): 4"]
