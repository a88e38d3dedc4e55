"""Annual maxima, flood-frequency fits, event scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.special import gamma_cdf, gamma_ppf, normal_ppf, pearson3_ppf  # noqa: F401  their former place
from freshet.operators import pearson
from freshet.operators.moments import sample_moments, station_skew_mse, weighted_skew  # noqa: F401

EULER = 0.5772156649015329


def water_year(t: str, start_month: int = 1) -> Column:
    year = F.year(t)
    return year if start_month == 1 else year + F.when(F.month(t) >= start_month, 1).otherwise(0)


def annual_maxima(df: DataFrame, key: str, t: str, value: str, max_missing: int = 100, start_month: int = 1) -> DataFrame:
    """Largest value of each (water) year with at least 365 - max_missing valid days; negatives don't count."""
    valid = df.where(F.col(value) >= 0)
    years = valid.groupBy(key, water_year(t, start_month).alias("year")).agg(F.count(F.lit(1)).alias("days"), F.max(value).alias("peak"))
    return years.where(F.col("days") >= 365 - max_missing)


def gumbel_k(period: Column) -> Column:
    """Frequency factor of a return period."""
    return -math.sqrt(6) / math.pi * (EULER + F.log(F.log(period / (period - 1))))


def fit_gumbel(peaks: DataFrame, key: str, value: str, min_years: int = 8) -> DataFrame:
    """Method of moments; keys with too few years or hardly any flow have no fit."""
    fit = peaks.groupBy(key).agg(F.count(value).alias("years"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return fit.where((F.col("years") >= min_years) & (F.col("mean") > 1e-3))


def gumbel_flows(fit: DataFrame, key: str, periods: list[float]) -> DataFrame:
    """Flow of each period: mean + K(T) std."""
    period = F.explode(F.array(*[F.lit(float(t)) for t in periods]))
    return fit.select(key, "mean", "std", period.alias("period")).select(key, "period", F.greatest(F.lit(0.0), F.col("mean") + gumbel_k(F.col("period")) * F.col("std")).alias("flow"))


def ev1_line(levels: DataFrame, key: str) -> DataFrame:
    """Least squares of flow on the Gumbel factor of known levels (key, period, flow)."""
    k = gumbel_k(F.col("period"))
    return levels.groupBy(key).agg(F.regr_slope("flow", k).alias("slope"), F.regr_intercept("flow", k).alias("intercept"))


def index_flood(flow: Column, period: Column, factor: float = 3.3, cv: float = 0.45) -> Column:
    """Flow of a period from a mean flow alone: a mean annual flood of factor x flow with a given variation."""
    return flow * factor * (1 + gumbel_k(period) * cv)


def plotting_positions(peaks: DataFrame, key: str, value: str, alpha: float = 0.4) -> DataFrame:
    """Exceedance chance (rank - a) / (n + 1 - 2a) of each peak, largest first."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(value).desc(), "year"))
    return peaks.withColumn("rank", rank).withColumn("exceedance", (F.col("rank") - alpha) / (n + 1 - 2 * alpha))


def threshold_positions(peaks: DataFrame, key: str, value: str, threshold: str, alpha: float = 0.0) -> DataFrame:
    """peaks with band and exceedance: plotting positions where each year's peak is known only above its own threshold.

    Thresholds cut a key's values into bands. From the top, a band's share of the years whose threshold it reaches and
    whose peak lies in it or below is its conditional chance; 1 minus it, multiplied over the bands above, is what is left for
    it (Hirsch and Stedinger, 1987), and its peaks divide its own part evenly. A NULL threshold is no limit. Only
    windows by key: bands are numbered and counted, years never meet thresholds in pairs.
    """
    own = Window.partitionBy(key)
    none = F.lit(float("-inf"))
    rows = peaks.where(F.col(value).isNotNull()).withColumn("_limit", F.coalesce(F.col(threshold).cast("double"), none)).withColumn("_value", F.col(value).cast("double"))
    levels = rows.select(key, "_limit").distinct().union(rows.select(key, none.alias("_limit")).distinct()).distinct()
    levels = levels.withColumn("_band", F.row_number().over(own.orderBy(F.desc("_limit"))))
    rows = rows.join(levels.withColumnRenamed("_band", "_known"), [key, "_limit"])
    both = rows.select(*rows.columns, F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_band")).unionByName(
        levels.select(key, F.col("_limit").alias("_value"), F.lit(0).alias("_kind"), "_band"), allowMissingColumns=True)
    upto = own.orderBy("_value", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_band", F.last("_band", ignorenulls=True).over(upto)).where("_kind = 1")
    counts = rows.groupBy(key, F.col("_band").alias("_b")).agg(F.count(F.lit(1)).alias("_k"))
    known = rows.groupBy(key, F.least("_band", "_known").alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    bands = levels.select(key, F.col("_band").alias("_b"), "_limit").join(counts, [key, "_b"], "left").join(known.withColumnRenamed("_g", "_b"), [key, "_b"], "left")
    bands = bands.withColumn("_years", F.sum(F.coalesce("_n", F.lit(0))).over(own.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0))).where("_k > 0")
    share = F.when((F.col("_limit") == none) | (F.col("_years") <= 0), 1.0).otherwise(F.col("_k") / F.greatest("_years", "_k"))
    above = own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_share", share).withColumn("_left", F.coalesce(F.product(1 - F.col("_share")).over(above), F.lit(1.0)))
    placed = rows.join(bands.select(key, F.col("_b").alias("_band"), "_k", "_share", "_left"), [key, "_band"])
    down = F.row_number().over(Window.partitionBy(key, "_band").orderBy(F.desc("_value")))
    at = (down - alpha) / (F.col("_k") + 1 - 2 * alpha)
    return placed.select(*peaks.columns, F.col("_band").alias("band"), (1 - F.col("_left") + F.col("_left") * F.col("_share") * at).alias("exceedance"))


def fit_loglog(peaks: DataFrame, key: str, value: str, alpha: float = 0.0) -> DataFrame:
    """Regression of log10(-log10 p) on log10 of the flow, p the plotting position of exceedance."""
    p = plotting_positions(peaks.where(F.col(value) > 0), key, value, alpha)
    y, x = F.log10(-F.log10(F.col("exceedance"))), F.log10(value)
    return p.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def empirical_pdf(peaks: DataFrame, key: str, value: str, bins: int = 5) -> DataFrame:
    """Share of values in equal bins between a key's extremes; the last bin is closed."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    b = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(value) - low, high - low) * bins))
    n = F.count(F.lit(1)).over(w)
    return peaks.select(key, F.when(high > low, b).otherwise(0).cast("int").alias("bin"), n.alias("n")).groupBy(key, "bin").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))


def classify_exceedance(q: Column, levels: dict[float, Column]) -> Column:
    """Rank 0 to 4 by the 2, 5, 20 and 100-year flows; NULL without flow or levels."""
    two, five, twenty, hundred = (levels[t] for t in (2, 5, 20, 100))
    return F.when(q.isNull() | two.isNull(), None).when(q >= hundred, 4).when(q >= twenty, 3).when(q >= five, 2).when(q >= two, 1).otherwise(0)


def return_period_estimate(q: Column, levels: list[tuple[float, Column]]) -> Column:
    """Period of a flow by interpolation in Gumbel's factor between known levels; NULL below the first, 1000 at most.

    Levels that are missing or don't exceed all before them are left out; fewer than two levels give NULL.
    """
    k = lambda t: -math.sqrt(6) / math.pi * (EULER + math.log(math.log(t / (t - 1))))
    known = F.array(*[F.struct(F.lit(k(t)).alias("k"), flow.cast("double").alias("q")) for t, flow in sorted(levels, key=lambda x: x[0])])
    none = F.lit(None).cast("array<struct<k:double,q:double>>")
    rising = lambda acc, x: F.when(x["q"].isNotNull() & (acc.isNull() | (x["q"] > F.element_at(acc, -1)["q"])), F.concat(F.coalesce(acc, F.array().cast("array<struct<k:double,q:double>>")), F.array(x))).otherwise(acc)
    kept = F.aggregate(known, none, rising)
    i = F.least(F.size(kept) - 1, F.size(F.filter(kept, lambda x: x["q"] <= q)))
    a, b = F.get(kept, i - 1), F.get(kept, i)
    factor = a["k"] + F.try_divide(q - a["q"], b["q"] - a["q"]) * (b["k"] - a["k"])
    inner = F.exp(-math.pi / math.sqrt(6) * factor - EULER)
    period = F.coalesce(F.try_divide(F.lit(1.0), 1 - F.exp(-inner)), F.lit(1000.0))
    return F.when((F.size(kept) >= 2) & (q >= F.get(kept, F.lit(0))["q"]), F.least(F.lit(1000.0), F.greatest(F.lit(1.0), period)))


def event_hits(df: DataFrame, key: str, t: str, value: str, threshold: Column, window: int, discard_any_missing: bool) -> Column:
    """1.0 or 0.0: whether the reference comes to the threshold within +-window rows; NULL if the window is discarded."""
    w = Window.partitionBy(key).orderBy(t).rowsBetween(-window, window)
    best, valid, rows = F.max(value).over(w), F.count(value).over(w), F.count(F.lit(1)).over(w)
    keep = (valid == rows) if discard_any_missing else (valid > 0)
    return F.when(keep, (best >= threshold).cast("double"))


def period_scores(df: DataFrame, thresholds: DataFrame, keys: list[str], t: str, period: str, windows: list[int]) -> DataFrame:
    """flood_event_scores of each key, period and window: thresholds (keys, period, obs_threshold, sim_threshold) meet their key's series.

    A series is repeated once for each of its periods, whose number is fixed, and marked once for each window.
    """
    long = df.join(thresholds, keys).withColumn("_key", F.struct(*keys, period))
    each = [flood_event_scores(long, "_key", t, w, "obs_threshold", "sim_threshold").withColumn("window", F.lit(w)) for w in windows]
    both = each[0]
    for more in each[1:]:
        both = both.unionByName(more)
    return both.select("_key.*", *[c for c in both.columns if c != "_key"])


def flood_event_scores(df: DataFrame, key: str, t: str, window: int, obs_threshold: str, sim_threshold: str) -> DataFrame:
    """Precision, recall and F1 of threshold crossings; missing where there is nothing to score."""
    from freshet.operators.frame import up_crossings

    marked = df.select(
        key, t,
        up_crossings(df, key, t, "obs", F.col(obs_threshold)).alias("_o"), up_crossings(df, key, t, "sim", F.col(sim_threshold)).alias("_s"),
        event_hits(df, key, t, "obs", F.col(obs_threshold), window, True).alias("_ho"), event_hits(df, key, t, "sim", F.col(sim_threshold), window, False).alias("_hs"),
    )
    out = marked.groupBy(key).agg(
        F.count_if("_o").alias("n_obs"), F.count_if("_s").alias("n_sim"), F.avg(F.when(F.col("_s"), F.col("_ho"))).alias("precision"), F.avg(F.when(F.col("_o"), F.col("_hs"))).alias("recall")
    )
    p, r = F.col("precision"), F.col("recall")
    # No valid crossing on either side leaves nothing to score; on one side alone the score is 0.
    f1 = F.when(p.isNull() & r.isNull(), None).when(F.coalesce(p, F.lit(0.0)) + F.coalesce(r, F.lit(0.0)) == 0, 0.0).when(p.isNull() | r.isNull(), 0.0).otherwise(2 * p * r / (p + r))
    return out.withColumn("f1", f1)


def _greedy(values: np.ndarray, separation: int, limit: float, n: int | None) -> list[int]:
    left, picked = values.copy(), []
    while (n is None or len(picked) < n) and np.isfinite(left).any():
        i = int(np.nanargmax(np.where(np.isfinite(left), left, -np.inf)))
        if not left[i] > limit:
            break
        picked.append(i)
        left[max(0, i - separation) : i + separation + 1] = -np.inf
    return picked


def peaks_over_threshold(df: DataFrame, key: str, t: str, value: str, separation: int = 7, quantile: float | None = 0.95, n: int | None = None) -> DataFrame:
    """Greedy peaks: take the largest value above a quantile of the series, blank +-separation rows, and so on.

    Sequential within a series, so a task takes a whole series of days; parallel over keys. With n the n highest peaks.
    """
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        v = pdf[value].to_numpy(float)
        good = v[np.isfinite(v)]
        limit = -np.inf if quantile is None or not len(good) else float(np.quantile(good, quantile))
        at = _greedy(v, separation, limit, n)
        return pd.DataFrame({key: pdf[key].iloc[at].to_numpy(), t: pdf[t].iloc[at].to_numpy(), "peak": v[at], "rank": np.arange(1, len(at) + 1)})

    return df.select(key, t, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {t} {kinds[t]}, peak double, rank int")


def lp3_flows(moments: DataFrame, key: str, periods: list[float]) -> DataFrame:
    """Log-Pearson III flows from moments of log10 peaks and p_positive, the share of peaks that aren't zero."""
    return pearson.flows_of_periods(moments, key, periods)


def fit_lp3(peaks: DataFrame, key: str, value: str, least: int = 5) -> DataFrame:
    """Moments of log10 of positive peaks, with the share of positive ones; keys with fewer than `least` have no fit."""
    share = peaks.groupBy(key).agg(F.avg((F.col(value) > 0).cast("double")).alias("p_positive"))
    m = sample_moments(peaks.where(F.col(value) > 0), [key], F.log10(value)).where(F.col("n") >= least)
    return m.join(share, key)


def gumbel_periods(flows: DataFrame, fit: DataFrame, key: str, value: str) -> DataFrame:
    """Return period of each flow under its key's Gumbel fit; NULL without a fit or spread, infinite beyond doubles."""
    k = F.try_divide(F.col(value) - F.col("mean"), F.col("std"))
    chance = -F.expm1(-F.exp(-(math.pi / math.sqrt(6) * k + EULER)))
    period = F.when(chance == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), chance))
    return flows.join(fit.select(key, "mean", "std"), key, "left").withColumn("period", period).drop("mean", "std")


def loglog_flows(fit: DataFrame, key: str, periods: list[float]) -> DataFrame:
    """Flow of each period on the line of fit_loglog; NULL where the line is flat."""
    period = F.explode(F.array(*[F.lit(float(t)) for t in periods]))
    flow = F.pow(F.lit(10.0), F.try_divide(F.log10(F.log10("period")) - F.col("intercept"), F.col("slope")))
    return fit.select(key, "slope", "intercept", period.alias("period")).select(key, "period", flow.alias("flow"))


def loglog_periods(flows: DataFrame, fit: DataFrame, key: str, value: str) -> DataFrame:
    """Return period of each flow on its key's line; NULL without a line or for flows that aren't positive."""
    line = F.col("intercept") + F.col("slope") * F.log10(value)
    period = F.when(F.col(value) > 0, F.pow(F.lit(10.0), F.pow(F.lit(10.0), line)))
    return flows.join(fit.select(key, "slope", "intercept"), key, "left").withColumn("period", period).drop("slope", "intercept")
