"""Pearson III distributions for many keys at once, and their fit by expected moments where low peaks are censored."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions.special import gamma_tails, gamma_weight, pearson3_cdf, pearson3_ppf
from freshet.operators import outliers
from freshet.operators.moments import sample_moments, station_skew_mse, weighted_skew

#: Exceedances of flows stay this far from 0 and 1.
MARGIN = 1e-6
#: A skew is at least this (bulletin 17C), and this far from zero.
LEAST_SKEW, SMALL_SKEW = -1.41, 1e-4
ITERATIONS, CONVERGED = 1000, 1e-10


def _mse(skew: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean squared error of station skews (bulletin 17B)."""
    g = np.abs(skew)
    a = np.where(g <= 0.90, -0.33 + 0.08 * g, -0.52 + 0.30 * g)
    b = np.where(g <= 1.50, 0.94 - 0.26 * g, 0.55)
    return 10.0 ** (a - b * np.log10(n / 10.0))


def _off_zero(skew: np.ndarray) -> np.ndarray:
    return np.where(np.abs(skew) < SMALL_SKEW, np.where(skew < 0, -SMALL_SKEW, SMALL_SKEW), skew)


def moments_below(limit: np.ndarray, mean: np.ndarray, std: np.ndarray, skew: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First three moments of (X - mean) / std, X Pearson III and below `limit`.

    With Y = X in units of its gamma variable of shape a, integration by parts gives E[(Y - a) h(Y)] as E[Y h'(Y)] and
    a term at the limit, for h = 1, Y - a and its square in turn; nothing cancels however large a is. A limit
    outside the support counts as the value itself.
    """
    a = 4 / skew**2
    at = (limit - mean) / std
    y = a + at * np.sqrt(a) * np.sign(skew)
    inside = y > 0
    lower, upper = gamma_tails(a, np.where(inside, y, 1.0))
    share = np.where(skew > 0, lower, upper)
    known = inside & (share > 1e-300)
    edge = np.where(known, gamma_weight(a, np.where(inside, y, 1.0)) / np.where(known, share, 1.0), 0.0) * np.sign(skew)
    off = y - a
    d1 = -edge
    d2 = a + d1 - edge * off
    d3 = 2 * (d2 + a * d1) - edge * off**2
    unit = np.sign(skew) / np.sqrt(a)
    outside = ~known
    whole = outside & (skew < 0) & ~inside  # all of a distribution bounded above lies below the limit
    z = [d1 * unit, d2 * unit**2, d3 * unit**3]
    return tuple(np.where(whole, full, np.where(outside, at**k, v)) for k, v, full in zip((1, 2, 3), z, (0.0, 1.0, skew)))


def expected_moments(below: np.ndarray, limit: np.ndarray, n: np.ndarray, mean: np.ndarray, std: np.ndarray, skew: np.ndarray, regional: np.ndarray, regional_mse: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """mean, std, skew and iterations of samples with n values of the given moments and `below` more below `limit`.

    The fixed point of the moments that follow when the censored values have those expected under the last
    ones (bulletin 17C, appendix 7). All samples are iterated together, each until it moves by CONVERGED at most;
    those that don't settle have NaN. NaN regional values: no weighting of the skew.
    """
    total = n + below
    squares = std**2 * (n - 1)
    cubes = skew * std**3 * (n - 1) * (n - 2) / n
    more2, more3 = n / (n - 1), n**2 / ((n - 1) * (n - 2))
    own = [mean.copy(), std.copy(), _off_zero(skew)]
    steps = np.zeros(len(n), np.int64)
    live = np.flatnonzero((std > 0) & (n >= 3))
    own[2][(std <= 0) | (n < 3)] = np.nan
    for step in range(1, ITERATIONS + 1):
        if not len(live):
            break
        m, s, g = (v[live] for v in own)
        k, t, c = below[live], total[live], n[live]
        z1, z2, z3 = moments_below(np.where(k > 0, limit[live], m), m, s, g)
        new_mean = (c * mean[live] + k * (m + s * z1)) / t
        shift, d = m - new_mean, mean[live] - new_mean
        e2 = s**2 * z2 + 2 * s * shift * z1 + shift**2
        e3 = s**3 * z3 + 3 * s**2 * shift * z2 + 3 * s * shift**2 * z1 + shift**3
        second = (more2[live] * (squares[live] + c * d**2) + k * e2) / t
        third = (more3[live] * (cubes[live] + 3 * d * squares[live] + c * d**3) + k * e3) / t
        new_std = np.sqrt(np.maximum(second, 1e-30))
        new_skew = third / new_std**3
        r, e = regional[live], regional_mse[live]
        mse = _mse(new_skew, t)
        new_skew = np.where(np.isnan(r), new_skew, (e * new_skew + mse * r) / (e + mse))
        new_skew = _off_zero(np.maximum(new_skew, LEAST_SKEW))
        moved = np.maximum.reduce([np.abs(new_mean - m), np.abs(new_std - s), np.abs(new_skew - g)])
        for v, new in zip(own, (new_mean, new_std, new_skew)):
            v[live] = new
        steps[live] = step
        live = live[~(moved <= CONVERGED)]
    for v in own:
        v[live] = np.nan  # no fixed point
    return *own, steps


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("mean", "std", "skew")] + [T.StructField("iterations", T.LongType())]))
def _fitted(below: pd.Series, limit: pd.Series, n: pd.Series, mean: pd.Series, std: pd.Series, skew: pd.Series, regional: pd.Series, regional_mse: pd.Series) -> pd.DataFrame:
    found = expected_moments(*(v.to_numpy(float) for v in (below, limit, n, mean, std, skew, regional, regional_mse)))
    return pd.DataFrame(dict(zip(("mean", "std", "skew", "iterations"), found)))


def fit_ema(peaks: DataFrame, key: str, value: str, regional_skew: float | None = None, regional_mse: float | None = None, low: str = "multiple") -> DataFrame:
    """key, n, n_low, threshold, mean, std, skew, iterations: log-Pearson III by expected moments.

    Low outliers and zeros, found by the multiple or the single Grubbs-Beck test, count as peaks below the threshold
    (0 where there are none). Series are reduced to counts and moments by key; only those rows meet Python, a batch
    of keys at a time. Keys with fewer than five positive peaks, equal peaks or no fixed point have no row; missing, negative and
    infinite peaks don't count.
    """
    if (regional_skew is None) != (regional_mse is None):
        raise ValueError("regional_skew and regional_mse go together")
    test = {"multiple": outliers.multiple_grubbs_beck, "single": outliers.grubbs_beck}[low]
    valid = peaks.where((F.col(value) >= 0) & (F.col(value) < float("inf"))).select(key, F.col(value).cast("double").alias("_peak"))
    zeros = valid.groupBy(key).agg(F.count_if(F.col("_peak") == 0).alias("_zeros"), F.min(F.when(F.col("_peak") > 0, F.col("_peak"))).alias("_least"), F.count(F.lit(1)).alias("_all"))
    tested = zeros.where(F.col("_all") - F.col("_zeros") >= 5).join(test(valid, key, "_peak"), key, "left")
    below = F.coalesce(F.col("n_low"), F.lit(0))
    below = F.when(F.lit(low == "single"), below + F.col("_zeros")).otherwise(F.greatest(below, F.col("_zeros")))
    limit = F.coalesce(F.col("threshold"), F.when(below > 0, F.col("_least")), F.lit(0.0))
    tested = tested.select(key, below.alias("n_low"), limit.alias("threshold"))
    exact = valid.join(tested, key).where((F.col("_peak") > 0) & (F.col("_peak") >= F.col("threshold")))
    exact = sample_moments(exact, [key, "n_low", "threshold"], F.log10("_peak"))
    number = lambda v: F.lit(float("nan") if v is None else float(v))
    log = F.when(F.col("threshold") > 0, F.log10("threshold")).otherwise(0.0)
    fit = _fitted(F.col("n_low").cast("double"), log, F.col("n").cast("double"), "mean", "std", F.coalesce("skew", F.lit(0.0)), number(regional_skew), number(regional_mse))
    out = exact.where("n >= 3 AND std > 0").select(key, "n", "n_low", "threshold", fit.alias("fit"))
    return out.select(key, "n", "n_low", "threshold", "fit.*").where(~F.isnan("skew"))


# --- flows and periods -----------------------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def _quantile(p: pd.Series, mean: pd.Series, std: pd.Series, skew: pd.Series) -> pd.Series:
    return pd.Series(pearson3_ppf(*(v.to_numpy(float) for v in (p, mean, std, skew))))


@F.pandas_udf(T.DoubleType())
def _chance_below(x: pd.Series, mean: pd.Series, std: pd.Series, skew: pd.Series) -> pd.Series:
    return pd.Series(pearson3_cdf(*(v.to_numpy(float) for v in (x, mean, std, skew))))


def _with_share(fit: DataFrame) -> DataFrame:
    """p_positive: the share of peaks that the distribution describes; 1 for fits that count zeros as censored."""
    fit = fit if "p_positive" in fit.columns else fit.withColumn("p_positive", F.lit(1.0))
    return fit.withColumn("skew", F.coalesce("skew", F.lit(0.0)))


def flows_at(fit: DataFrame, key: str, exceedances: list[float]) -> DataFrame:
    """key, exceedance, flow: the flow that a year exceeds with each chance; 0 where that is as likely as any flow at all."""
    if any(not 0 < p < 1 for p in exceedances):
        raise ValueError("exceedances lie between 0 and 1")
    each = _with_share(fit).select(key, "mean", "std", "skew", "p_positive", F.explode(F.array(*[F.lit(float(p)) for p in exceedances])).alias("exceedance"))
    among = F.col("exceedance") / F.col("p_positive")
    log = _quantile(F.when(among < 1, 1 - among).otherwise(0.5), "mean", "std", "skew")
    return each.select(key, "exceedance", F.when(among < 1, F.pow(F.lit(10.0), log)).otherwise(0.0).alias("flow"))


def flows_of_periods(fit: DataFrame, key: str, periods: list[float]) -> DataFrame:
    """key, period, flow."""
    if any(not t > 1 for t in periods):
        raise ValueError("periods are longer than a year")
    names = F.create_map(*[F.lit(v) for t in periods for v in (1.0 / t, float(t))])
    return flows_at(fit, key, [1.0 / t for t in periods]).select(key, names[F.col("exceedance")].alias("period"), "flow")


def flows_of_percentiles(fit: DataFrame, key: str, percentiles: list[float]) -> DataFrame:
    """key, percentile, flow: the flow that a year stays below with each chance."""
    names = F.create_map(*[F.lit(v) for p in percentiles for v in (1.0 - p, float(p))])
    return flows_at(fit, key, [1.0 - p for p in percentiles]).select(key, names[F.col("exceedance")].alias("percentile"), "flow")


def chances_of(flows: DataFrame, fit: DataFrame, key: str, value: str) -> DataFrame:
    """flows with exceedance, percentile (its complement) and period (its inverse); NULL without a fit or a valid flow."""
    f = flows.join(_with_share(fit).select(key, "mean", "std", "skew", "p_positive"), key, "left")
    below = _chance_below(F.when(F.col(value) > 0, F.log10(value)).otherwise(0.0), "mean", "std", "skew")
    chance = F.when(F.col(value) > 0, F.col("p_positive") * (1 - below)).when(F.col(value) == 0, F.col("p_positive"))
    f = f.withColumn("exceedance", F.when(F.col("mean").isNotNull() & chance.isNotNull(), F.least(F.greatest(chance, F.lit(MARGIN)), F.lit(1 - MARGIN))))
    return f.withColumn("percentile", 1 - F.col("exceedance")).withColumn("period", 1 / F.col("exceedance")).drop("mean", "std", "skew", "p_positive")


def chance_of_bins(fit: DataFrame, key: str, edges: list[float]) -> DataFrame:
    """key, bin (from 1), low, high, chance: the share of peaks, as logarithms, between neighbouring edges."""
    each = _with_share(fit).select(key, "mean", "std", "skew", F.posexplode(F.array(*[F.lit(float(e)) for e in edges])).alias("i", "edge"))
    each = each.withColumn("below", _chance_below("edge", "mean", "std", "skew"))
    both = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "edge", "below"))).alias("e"))  # as many as there are edges
    bins = both.select(key, F.explode(F.sequence(F.lit(1), F.lit(len(edges) - 1))).alias("bin"), "e")
    at = lambda i, c: F.element_at("e", i)[c]
    b = F.col("bin")
    return bins.select(key, "bin", at(b, "edge").alias("low"), at(b + 1, "edge").alias("high"), (at(b + 1, "below") - at(b, "below")).alias("chance"))


def unit_differences(peaks: DataFrame, key: str, value: str, factor: float, exceedances: list[float]) -> DataFrame:
    """key, most_percent, low_differs: how far flows fitted to scaled peaks differ from scaled flows, and whether the low outliers do."""
    def fitted(scale: float) -> tuple[DataFrame, DataFrame]:
        fit = fit_ema(peaks.select(key, (F.col(value) * scale).alias(value)), key, value)
        return fit.select(key, F.col("n_low").alias(f"n_{scale != 1}")), flows_at(fit, key, exceedances).select(key, "exceedance", (F.col("flow") / scale).alias(f"flow_{scale != 1}"))

    (low, flows), (other_low, other) = fitted(1.0), fitted(factor)
    off = F.abs(F.col("flow_True") / F.nullif(F.col("flow_False"), F.lit(0.0)) - 1) * 100
    return flows.join(other, [key, "exceedance"]).groupBy(key).agg(F.max(off).alias("most_percent")).join(low, key).join(other_low, key).select(
        key, "most_percent", (F.col("n_False") != F.col("n_True")).alias("low_differs"))


def skew_weights(fit: DataFrame, key: str, regional: float, regional_mse: float) -> DataFrame:
    """key, skew, mse and the skew weighted with a regional one, from n and skew."""
    mse = station_skew_mse(F.col("skew"), F.col("n"))
    return fit.select(key, "skew", mse.alias("mse"), weighted_skew(F.col("skew"), mse, regional, regional_mse).alias("weighted"))
