"""Log-Pearson fits against published tables, and the functions under them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import special
from freshet.operators import frequency, pearson
from test_outliers import ORESTIMBA

# Annual peaks of Moose River 1947-2014 aren't repeated here; Orestimba Creek's published fit is.
PUBLISHED = {0.50: 1339, 0.20: 4026, 0.10: 6328, 0.04: 9426, 0.02: 11690, 0.01: 13820, 0.005: 15800, 0.002: 18150}


def creek(spark, scale=1.0):
    return spark.createDataFrame([("creek", float(v) * scale) for v in ORESTIMBA.split()], "k string, peak double")


def test_special_functions():
    x = np.array([0.1, 0.5, 1.5, 7, 9.99, 12, 100, 1e6])
    np.testing.assert_allclose(special.log_gamma(x), [math.lgamma(v) for v in x], atol=1e-13, rtol=1e-14)
    np.testing.assert_allclose(special.normal_cdf([-30, -8, -1, 0, 3]), [0.5 * math.erfc(v / math.sqrt(2)) for v in (30, 8, 1, 0, -3)], rtol=1e-13)
    for a in (0.05, 1, 50, 9e3, 2e4, 1e6):
        p = np.array([1e-9, 1e-4, 0.5, 0.998])
        np.testing.assert_allclose(special.gamma_tails(a, special.gamma_ppf(a, p))[0], p, rtol=1e-9)
        np.testing.assert_allclose(special.gamma_tails(a, special.gamma_ppf(a, p, upper=True))[1], p, rtol=1e-9)
    x = np.array([9700.0, 9990, 10000, 10000.5, 10300])  # the expansion takes over above this shape
    np.testing.assert_allclose(special._uniform(np.full(5, 1e4), x)[0], special.gamma_tails(1e4, x)[0], rtol=1e-8)


@pytest.mark.parametrize("skew", [-1.2, -0.3, -0.004, 0.004, 0.3, 2.5])
def test_moments_below_against_draws(skew):
    rng = np.random.default_rng(1)
    a = 4 / skew**2
    z = np.sign(skew) * (rng.gamma(a, size=400_000) - a) / math.sqrt(a)
    for limit in (-1.0, 0.0, 1.5):
        own = z[z < limit]
        got = pearson.moments_below(*(np.array([v]) for v in (5 + 2 * limit, 5.0, 2.0, skew)))
        if len(own) > 1000:
            np.testing.assert_allclose([v[0] for v in got], [(own**k).mean() for k in (1, 2, 3)], atol=0.05, rtol=0.03)
    far = pearson.moments_below(*(np.array([v]) for v in (-1000.0, 0.0, 1.0, 1.0)))  # outside the support: the limit itself
    assert far[0][0] == -1000 and far[1][0] == 1e6


def test_published_creek(spark):
    fit = pearson.fit_ema(creek(spark), "k", "peak")
    r = fit.first()
    assert (r.n, r.n_low, r.threshold) == (52, 30, 782.0)
    np.testing.assert_allclose([r["mean"], r["std"], r["skew"]], [3.0227, 0.6821, -0.9291], atol=5e-4)
    flows = {x.exceedance: x.flow for x in pearson.flows_at(fit, "k", list(PUBLISHED)).collect()}
    np.testing.assert_allclose([flows[p] for p in PUBLISHED], list(PUBLISHED.values()), rtol=5e-4)
    back = pearson.chances_of(spark.createDataFrame([("creek", flows[p]) for p in PUBLISHED] + [("creek", 0.0), ("none", 5.0), ("creek", None)], "k string, q double"), fit, "k", "q")
    got = {x.q: x.exceedance for x in back.where("k = 'creek'").collect()}
    np.testing.assert_allclose([got[flows[p]] for p in PUBLISHED], list(PUBLISHED), rtol=1e-8)
    assert got[0.0] == 1 - pearson.MARGIN and got[None] is None and back.where("k = 'none'").first().period is None
    single = pearson.fit_ema(creek(spark), "k", "peak", low="single").first()
    assert single.threshold > 0 and single.n_low >= 12


def test_units_dont_matter(spark):
    r = pearson.unit_differences(creek(spark), "k", "peak", 1e-6, [0.5, 0.1, 0.01, 0.002]).first()
    assert not r.low_differs and r.most_percent < 1e-8


def test_no_censoring_is_the_method_of_moments(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(v)) for k in "abc" for v in 10 ** rng.normal(2, 0.2, 60)] + [("flat", 5.0)] * 9 + [("few", 1.0), ("few", 2.0), ("zeros", 0.0), (None, 3.0)]
    peaks = spark.createDataFrame(rows, "k string, peak double")
    ema = {r.k: r for r in pearson.fit_ema(peaks, "k", "peak").where("n_low = 0").collect()}
    plain = {r.k: r for r in frequency.fit_lp3(peaks, "k", "peak").collect()}
    assert ema and "flat" not in ema and "few" not in ema
    for k, r in ema.items():
        np.testing.assert_allclose([r["mean"], r["std"], r["skew"]], [plain[k]["mean"], plain[k]["std"], plain[k]["skew"]], rtol=1e-9)
    weighted = {r.k: r.skew for r in pearson.fit_ema(peaks, "k", "peak", 0.44, 0.078).where("n_low = 0").collect()}
    one = next(iter(ema))
    mse = pearson._mse(np.array([plain[one]["skew"]]), np.array([60.0]))[0]
    assert weighted[one] == pytest.approx((0.078 * plain[one]["skew"] + mse * 0.44) / (0.078 + mse), rel=1e-9)
    with pytest.raises(ValueError):
        pearson.fit_ema(peaks, "k", "peak", 0.1)
    assert pearson.fit_ema(peaks.limit(0), "k", "peak").count() == 0


def test_near_symmetric_with_low_values(spark):
    rows = [("s", float(10**v)) for v in [0.5, 0.6, *np.linspace(2.5, 4.5, 41)]]
    fit = pearson.fit_ema(spark.createDataFrame(rows, "k string, peak double"), "k", "peak")
    assert all(math.isfinite(r.flow) for r in pearson.flows_at(fit, "k", [0.5, 0.1, 0.01]).collect()) and fit.first().n_low == 2


def plain_positions(values, limits, alpha):
    out, done, p = {}, set(), 0.0
    for low in [*sorted(set(limits), reverse=True), -math.inf]:
        band = sorted((i for i in range(len(values)) if i not in done and values[i] >= low), key=lambda i: -values[i])
        years = sum(limits[i] <= low and i not in done for i in range(len(values)))
        if not band:
            continue
        then = 1.0 if low == -math.inf or years <= 0 else p + (1 - p) * len(band) / max(years, len(band))
        for rank, i in enumerate(band, 1):
            out[i] = p + (then - p) * (rank - alpha) / (len(band) + 1 - 2 * alpha)
        done |= set(band)
        p = then
    return out


def test_threshold_positions(spark):
    rng = np.random.default_rng(8)
    values = [float(v) for v in rng.permutation(400)[:60]]
    limits = [float(v) for v in rng.choice([0, 50, 120, 300], 60)]
    df = spark.createDataFrame([("a", i, v, t) for i, (v, t) in enumerate(zip(values, limits))] + [("b", i, v, 100.0) for i, v in enumerate([10.0, 20.0, 30.0, 100.0, 200.0, 300.0, 400.0, 500.0])], "k string, i long, v double, t double")
    got = {(r.k, r.i): r.exceedance for r in frequency.threshold_positions(df, "k", "v", "t", alpha=0.4).collect()}
    wanted = plain_positions(values, limits, 0.4)
    np.testing.assert_allclose([got["a", i] for i in range(60)], [wanted[i] for i in range(60)], rtol=1e-12)
    b = [got["b", i] for i in range(8)]
    assert all(v > 0.625 for v in b[:3]) and all(v < 0.625 for v in b[3:]) and b == sorted(b, reverse=True)
    free = frequency.threshold_positions(df.where("k = 'b'").withColumn("t", F.lit(None).cast("double")), "k", "v", "t").orderBy("i").collect()
    np.testing.assert_allclose([r.exceedance for r in free], [(8 - i) / 9 for i in range(8)])
