"""Low-outlier tests against published results, and against a plain loop."""

import math

import numpy as np
import pytest

from freshet.operators import frequency, outliers

# Annual peaks of Orestimba Creek 1932-2013, in cubic feet a second (bulletin 17C, appendix 10).
ORESTIMBA = """4260 345 516 1320 1200 2180 3230 115 3440 3070 1880 6450 1290 5970 782 0 0 335 175 2920 3660 147 0 16 5620 1440 10200 5380 448 0 1740
8300 156 560 128 4200 0 5080 1010 584 0 1510 922 1010 0 0 4360 1270 5210 1130 5550 6360 991 50 6990 112 0 0 4 1260 888 4190 12 12000 3130 3320 9470
833 2550 958 425 2790 2990 1820 1630 0 2110 310 4400 4440 0 6250"""


def frame(spark, series):
    return spark.createDataFrame([(k, float(v)) for k, vs in series.items() for v in vs], "k string, peak double")


def test_normal_cdf():
    x = np.linspace(-12, 8, 997)
    np.testing.assert_allclose(outliers.normal_cdf(x), [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], rtol=1e-8)


def test_noncentral_t_against_draws():
    rng = np.random.default_rng(7)
    for nu, delta, q in [(2.0, 0.5, 1.0), (5.0, 2.0, 3.0), (15.0, -1.0, 0.2)]:
        t = (rng.normal(size=400_000) + delta) / np.sqrt(rng.chisquare(nu, 400_000) / nu)
        got = outliers.noncentral_t_above(np.array([q]), np.array([nu]), np.array([delta]))[0]
        assert got == pytest.approx((t > q).mean(), abs=4e-3)


@pytest.mark.parametrize("r, omega, p, close", [(30, -2.04091670, 0.0006675, 1e-3), (31, -1.70491268, 0.0400, 1e-2)])
def test_published_chances(r, omega, p, close):
    assert outliers.order_statistic_p(np.array([82]), np.array([r]), np.array([omega]))[0] == pytest.approx(p, rel=close)


def test_chance_against_draws():
    """The approximation by moments is near the drawn share for the smallest of 15."""
    x = np.sort(np.random.default_rng(3).normal(size=(200_000, 15)), axis=1)
    w = (x[:, 0] - x[:, 1:].mean(axis=1)) / x[:, 1:].std(axis=1, ddof=1)
    assert outliers.order_statistic_p(np.array([15]), np.array([1]), np.array([-3.0]))[0] == pytest.approx((w < -3.0).mean(), abs=0.01)


def test_multiple_test(spark):
    creek = [int(v) for v in ORESTIMBA.split()]
    even = [10 ** (3 + 0.2 * frequency.normal_ppf((i + 0.5) / 60)) for i in range(60)]
    series = {"creek": creek, "small": [v * 1e-6 for v in creek], "even": even, "few": [1, 2, 3, 4, 0], "flat": [5] * 12, "odd": [*even, -1, float("nan"), float("inf")]}
    got = {r["k"]: r for r in outliers.multiple_grubbs_beck(frame(spark, series), "k", "peak").collect()}
    assert (got["creek"]["n_low"], got["creek"]["threshold"]) == (30, 782.0)
    assert got["small"]["n_low"] == 30 and got["small"]["threshold"] == pytest.approx(782e-6)
    assert (got["even"]["n_low"], got["even"]["threshold"]) == (0, None) == (got["odd"]["n_low"], got["odd"]["threshold"])
    assert got["flat"]["n_low"] == 0 and "few" not in got


def plain_17b(values):
    x, k = np.sort(np.log10(values)), 0
    while k <= len(x) - 10 and x[k] < x[k:].mean() - outliers.KN[min(len(x) - k, 149) - 10] * x[k:].std(ddof=1):
        k += 1
    return int((x < x[k]).sum()) if k else 0


def test_single_test(spark):
    rng = np.random.default_rng(42)
    series = {f"s{i}": [*(10 ** rng.normal(3.5, 0.15, 19 + i)), *([30.0] * (i % 3))] for i in range(12)} | {"nine": [1.0] * 9, "long": list(10 ** rng.normal(2, 1, 200))}
    got = {r["k"]: r["n_low"] for r in outliers.grubbs_beck(frame(spark, series), "k", "peak").collect()}
    assert got == {k: plain_17b(v) for k, v in series.items() if len(v) >= 10}


def test_periods_invert_flows(spark):
    peaks = spark.createDataFrame([("a", y, 10.0 * (y % 13) + y) for y in range(30)], "k string, year int, peak double")
    for fit, flows, periods in [
        (frequency.fit_gumbel(peaks, "k", "peak"), frequency.gumbel_flows, frequency.gumbel_periods),
        (frequency.fit_loglog(peaks, "k", "peak"), frequency.loglog_flows, frequency.loglog_periods),
    ]:
        at = flows(fit, "k", [2, 10, 100]).withColumnRenamed("period", "wanted")
        for r in periods(at, fit, "k", "flow").collect():
            assert r["period"] == pytest.approx(r["wanted"], rel=1e-6)
