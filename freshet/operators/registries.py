"""Users' own metrics and frequency fitters, by name, beside the built-in ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.operators import frequency, pearson, skill

#: A fitter makes (key, period, flow) of annual peaks: (peaks, key, value, periods).
Fitter = Callable[[DataFrame, str, str, list[float]], DataFrame]
FITTERS: dict[str, Fitter] = {}
#: Fewer positive peaks, or equal ones, give no thresholds.
LEAST_PEAKS = 5


# --- metrics ---------------------------------------------------------------------------------------------------


def register_metric(name: str, build: Callable[[str, str], Column] | None = None, series: Callable[[pd.Series, pd.Series], float] | None = None) -> None:
    """Adds a metric: `build` makes an aggregate column of the names of obs and sim, `series` a number of a group's two series.

    A series function runs as a grouped-aggregate pandas UDF, so a group must fit a task; a build stays in the JVM.
    """
    if (build is None) == (series is None):
        raise ValueError("a metric is either a column or a function of series")
    if name in skill.metric_columns() or name in skill.EXTRA:
        raise ValueError(f"there is a metric {name}")
    skill.EXTRA[name] = (build, series)


def unregister_metric(name: str) -> None:
    skill.EXTRA.pop(name, None)


# --- fitters ---------------------------------------------------------------------------------------------------


def register_fitter(name: str, fitter: Fitter) -> None:
    if name in FITTERS:
        raise ValueError(f"there is a fitter {name}")
    FITTERS[name] = fitter


def unregister_fitter(name: str) -> None:
    FITTERS.pop(name, None)


def grouped_fitter(flows: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Fitter:
    """A fitter of a function from a key's peaks and the periods to flows: a grouped map with a declared schema."""

    def fitter(peaks: DataFrame, key: str, value: str, periods: list[float]) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            found = flows(pdf[value].to_numpy(float), np.array(periods, float))
            return pd.DataFrame({key: [pdf[key].iloc[0]] * len(periods), "period": periods, "flow": np.asarray(found, float)})

        schema = T.StructType([peaks.schema[key], T.StructField("period", T.DoubleType()), T.StructField("flow", T.DoubleType())])
        return peaks.select(key, value).groupBy(key).applyInPandas(run, schema)

    return fitter


register_fitter("gumbel", lambda peaks, key, value, periods: frequency.gumbel_flows(frequency.fit_gumbel(peaks, key, value, LEAST_PEAKS), key, periods))
register_fitter("loglog", lambda peaks, key, value, periods: frequency.loglog_flows(frequency.fit_loglog(peaks, key, value), key, periods))
register_fitter("lp3", lambda peaks, key, value, periods: pearson.flows_of_periods(frequency.fit_lp3(peaks, key, value), key, periods))
register_fitter("ema", lambda peaks, key, value, periods: pearson.flows_of_periods(pearson.fit_ema(peaks, key, value), key, periods))


def series_thresholds(df: DataFrame, key: str, t: str, value: str, fitter: str, periods: list[float], max_missing: int = 100, start_month: int = 1) -> DataFrame:
    """(key, period, flow): thresholds of daily series by a registered fitter of their annual maxima.

    Keys with fewer than LEAST_PEAKS positive peaks, or whose peaks are equal, have NULL for each period. Negative flows are an error.
    """
    if fitter not in FITTERS:
        raise ValueError(f"no such fitter: {fitter}; there are {sorted(FITTERS)}")
    checked = F.when(F.col(value) < 0, F.raise_error(F.lit("a flow is negative")).cast("double")).otherwise(F.col(value))
    peaks = frequency.annual_maxima(df.withColumn(value, checked), key, t, value, max_missing, start_month).withColumn("peak", F.col("peak").cast("double"))
    positive = F.when(F.col("peak") > 0, F.col("peak"))
    enough = peaks.groupBy(key).agg(F.count(positive).alias("_n"), F.min(positive).alias("_a"), F.max(positive).alias("_b")).where((F.col("_n") >= LEAST_PEAKS) & (F.col("_b") > F.col("_a")))
    flows = FITTERS[fitter](peaks.join(enough.select(key), key, "left_semi"), key, "peak", periods)
    asked = df.select(key).distinct().withColumn("period", F.explode(F.array(*[F.lit(float(p)) for p in periods])))
    return asked.join(flows.select(key, "period", "flow"), [key, "period"], "left")
