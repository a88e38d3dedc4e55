"""Low outliers of annual peaks: the single test of bulletin 17B and the multiple test of bulletin 17C (Cohn and others, 2013)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions.special import log_gamma, normal_cdf, normal_density, normal_ppf

LEAST_17B = 10
# 10 % critical values of bulletin 17B, appendix 4, for 10 to 149 peaks.
KN = [
    2.036, 2.088, 2.134, 2.175, 2.213, 2.247, 2.279, 2.309, 2.335, 2.361, 2.385, 2.408, 2.429, 2.448, 2.467, 2.486, 2.502, 2.519, 2.534, 2.549,
    2.563, 2.577, 2.591, 2.604, 2.616, 2.628, 2.639, 2.65, 2.661, 2.671, 2.682, 2.692, 2.7, 2.71, 2.719, 2.727, 2.736, 2.744, 2.753, 2.76,
    2.768, 2.775, 2.783, 2.79, 2.798, 2.804, 2.811, 2.818, 2.824, 2.831, 2.837, 2.842, 2.849, 2.854, 2.86, 2.866, 2.871, 2.877, 2.883, 2.888,
    2.893, 2.897, 2.903, 2.908, 2.912, 2.917, 2.922, 2.927, 2.931, 2.935, 2.94, 2.945, 2.949, 2.953, 2.957, 2.961, 2.966, 2.97, 2.973, 2.977,
    2.981, 2.984, 2.989, 2.993, 2.996, 3.0, 3.003, 3.006, 3.011, 3.014, 3.017, 3.021, 3.024, 3.027, 3.03, 3.033, 3.037, 3.04, 3.043, 3.046,
    3.049, 3.052, 3.055, 3.058, 3.061, 3.064, 3.067, 3.07, 3.073, 3.075, 3.078, 3.081, 3.083, 3.086, 3.089, 3.092, 3.095, 3.097, 3.1, 3.102,
    3.104, 3.107, 3.109, 3.112, 3.114, 3.116, 3.119, 3.122, 3.124, 3.126, 3.129, 3.131, 3.133, 3.135, 3.138, 3.14, 3.142, 3.144, 3.146, 3.148,
]

def noncentral_t_above(q: np.ndarray, nu: np.ndarray, delta: np.ndarray, nodes: int = 128) -> np.ndarray:
    """P(t > q): the normal tail averaged over the logarithm of s, s^2 being chi-square by its degrees of freedom."""
    q, nu, delta = (v[:, None] for v in (q, nu, delta))
    low, high = -25 / nu, 0.5 * np.log(80 / nu + 2)
    x = low + (high - low) * np.linspace(0, 1, nodes)
    log_weight = nu * (x - np.exp(2 * x) / 2)
    weight = np.exp(log_weight - log_weight.max(axis=1, keepdims=True))
    return (normal_cdf(delta - q * np.exp(x)) * weight).sum(axis=1) / weight.sum(axis=1)


def _above(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance, third and fourth central moment of a standard normal value above z, from its hazard."""
    hazard = normal_density(z) / normal_cdf(-z)
    raw = [np.ones_like(z), hazard]
    for k in (2, 3, 4):
        raw.append((k - 1) * raw[k - 2] + z ** (k - 1) * hazard)
    mean = raw[1]
    centre = lambda k: sum(math.comb(k, j) * raw[j] * (-mean) ** (k - j) for j in range(k + 1))
    return mean, centre(2), centre(3), centre(4)


def _tail_given(z: np.ndarray, k: np.ndarray, omega: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """P((z - M) / S < omega) for the mean M and deviation S of k normal values above z.

    S^2 is taken as gamma distributed with its own mean and variance. M is split into a multiple of S and a rest
    that is uncorrelated with S, so that the event is one of a normal value and S, a noncentral t: a normal tail
    above 20 degrees of freedom (Abramowitz and Stegun 26.7.10). Places without a variance of the rest have NaN.
    """
    mean, var, third, fourth = _above(z)
    var_of_square = (fourth - var**2 * (k - 3) / (k - 1)) / k
    shape = var**2 / var_of_square
    root_mean = np.sqrt(var / shape) * np.exp(log_gamma(shape + 0.5) - log_gamma(shape))
    cov = third / (2 * np.sqrt(k * (k - 1)) * root_mean)
    share = cov / (var - root_mean**2)
    rest = np.sqrt(var / k - cov * share)
    t, off, freedom = -np.sqrt(var) * (omega + share) / rest, (mean - z - share * root_mean) / rest, 2 * shape
    p = normal_cdf(-((1 - 1 / (4 * freedom)) * t - off) / np.sqrt(1 + t * t / (2 * freedom)))
    few = (freedom <= 20) & wanted & np.isfinite(t)
    for i in np.flatnonzero(few.any(axis=1)):
        own = few[i]
        p[i, own] = noncentral_t_above(t[i, own], freedom[i, own], off[i, own])
    return p


def order_statistic_p(n: np.ndarray, r: np.ndarray, omega: np.ndarray, nodes: int = 61) -> np.ndarray:
    """Chance that the r-th smallest of n normal values lies omega or more deviations below the mean of those above it.

    The chance given that value z is averaged over its distribution by the trapezoid rule, over the places where it is known.
    """
    n, r, omega = (np.asarray(v, float)[:, None] for v in (n, r, omega))
    share = r / (n + 1)
    centre = normal_ppf(share).reshape(share.shape)
    width = np.sqrt(share * (1 - share) / (n + 2)) / normal_density(centre)
    z = centre + width * np.linspace(-11, 9, nodes)
    with np.errstate(all="ignore"):
        log_weight = (r - 1) * np.log(normal_cdf(z)) + (n - r) * np.log(normal_cdf(-z)) - z * z / 2
        weight = np.exp(log_weight - log_weight.max(axis=1, keepdims=True))
        p = _tail_given(z, n - r, omega, weight > 1e-13)
    known = np.isfinite(p)
    return np.clip(np.where(known, p * weight, 0).sum(axis=1) / np.where(known, weight, 0).sum(axis=1), 0, 1)


@F.pandas_udf(T.DoubleType())
def _p_value(n: pd.Series, r: pd.Series, omega: pd.Series) -> pd.Series:
    out = np.full(len(n), np.nan)
    at = np.flatnonzero(omega.notna().to_numpy())
    for i in range(0, len(at), 512):
        part = at[i : i + 512]
        out[part] = order_statistic_p(n.iloc[part], r.iloc[part], omega.iloc[part])
    return pd.Series(out).where(np.isfinite(out), None)


def omega_statistics(peaks: DataFrame, key: str, value: str, least: int = 5) -> DataFrame:
    """key, value, n, zeros, r, place, omega: each peak's distance below those above it, in their deviations.

    r numbers a key's peaks from the smallest and place shares the number among ties; omega is NULL above n // 2. A
    zero stands for its limit: below the last zero omega is free of scale, at the last zero NULL (its chance is 0).
    Peaks that are missing, negative or infinite don't count; keys with fewer than `least` positive ones are left out.
    """
    whole = Window.partitionBy(key)
    falling = whole.orderBy(F.col(value).desc())
    above = falling.rowsBetween(Window.unboundedPreceding, -1)
    log = F.when(F.col(value) > 0, F.log10(value))
    x = peaks.where((F.col(value) >= 0) & (F.col(value) < float("inf"))).select(
        key, F.col(value).cast("double").alias("value"), F.count(F.lit(1)).over(whole).alias("n"), F.count_if(F.col(value) == 0).over(whole).alias("zeros"),
        F.row_number().over(falling).alias("_down"), F.rank().over(whole.orderBy(value)).alias("place"), log.alias("_x"), F.avg(log).over(above).alias("_mean"), F.stddev_samp(log).over(above).alias("_std"),
    )
    n, zeros, r = F.col("n"), F.col("zeros"), F.col("n") - F.col("_down") + 1
    among_zeros = -F.sqrt((n - zeros) * (n - r - 1) / ((n - r) * F.nullif(zeros - r, F.lit(0))))
    omega = F.when(r < zeros, among_zeros).when(r > zeros, F.when(F.col("_std") > 0, (F.col("_x") - F.col("_mean")) / F.col("_std")).otherwise(0.0))
    kept = x.where(n - zeros >= least)
    return kept.select(key, "value", "n", "zeros", r.alias("r"), "place", F.when(r <= F.floor(n / 2), omega).alias("omega"))


def _threshold(x: DataFrame, key: str, k: str) -> DataFrame:
    """The value after the k smallest is the threshold; peaks below it are the outliers."""
    at = x.where(F.col("r") == F.col(k) + 1)
    out = F.col(k) > 0
    return at.select(key, F.when(out, F.col("place") - 1).otherwise(0).cast("long").alias("n_low"), F.when(out, F.col("value")).alias("threshold"))


def multiple_grubbs_beck(peaks: DataFrame, key: str, value: str, outward: float = 0.005, inward: float = 0.10) -> DataFrame:
    """key, n_low, threshold: low outliers by the multiple test; threshold is NULL where there are none.

    The largest r below n / 2 with a chance under `outward`, or the end of the first run with chances under `inward`,
    or all zeros, whichever is most. One shuffle by key: the chances are computed row by row in Arrow batches.
    """
    x = omega_statistics(peaks, key, value)
    p = F.when(F.col("r") == F.col("zeros"), F.lit(0.0)).otherwise(_p_value("n", "r", "omega"))
    x = x.withColumn("_p", F.when(F.col("r") <= F.floor(F.col("n") / 2), p))
    w = Window.partitionBy(key)
    far = F.coalesce(F.max(F.when(F.col("_p") < outward, F.col("r"))).over(w), F.lit(0))
    run = F.coalesce(F.min(F.when(F.col("_p") >= inward, F.col("r"))).over(w) - 1, F.floor(F.col("n") / 2))
    return _threshold(x.withColumn("_k", F.greatest(far, run, F.col("zeros"))), key, "_k")


def grubbs_beck(peaks: DataFrame, key: str, value: str) -> DataFrame:
    """key, n_low, threshold: low outliers of bulletin 17B, each tested against those not below it, until one passes.

    Positive peaks only; keys with fewer than 10 are left out, and the last 9 of a key are never tested.
    """
    log = F.log10(value)
    whole = Window.partitionBy(key)
    falling = whole.orderBy(F.col(value).desc())
    rest = falling.rowsBetween(Window.unboundedPreceding, 0)
    size = F.row_number().over(falling)
    x = peaks.where((F.col(value) > 0) & (F.col(value) < float("inf"))).select(
        key, F.col(value).cast("double").alias("value"), log.alias("_x"), F.count(F.lit(1)).over(whole).alias("n"), size.alias("_size"),
        F.rank().over(whole.orderBy(value)).alias("place"), F.avg(log).over(rest).alias("_mean"), F.stddev_samp(log).over(rest).alias("_std"),
    )
    critical = F.get(F.array(*[F.lit(v) for v in KN]), F.least(F.col("_size"), F.lit(LEAST_17B + len(KN) - 1)) - LEAST_17B)
    x = x.where(F.col("n") >= LEAST_17B).withColumn("r", F.col("n") - F.col("_size") + 1)
    passes = F.when(F.col("_size") >= LEAST_17B, F.col("_x") >= F.col("_mean") - critical * F.col("_std"))
    k = F.coalesce(F.min(F.when(passes, F.col("r"))).over(whole) - 1, F.col("n") - LEAST_17B + 1)
    return _threshold(x.withColumn("_k", k), key, "_k")
