"""Queries on log-Pearson fits, censored peaks and plotting positions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import frequency, pearson
from freshet.plans.base import VIEWS, query
from freshet.plans.outliers import monthly

R = lambda c, n=6: F.round(c, n)
EXCEEDANCES = [0.5, 0.1, 0.02, 0.01]


@query("ema_fit")
def ema_fit(spark, d):
    return pearson.fit_ema(monthly(spark, d), "basin", "peak")


@query("ema_regional_fit")
def ema_regional_fit(spark, d):
    return pearson.fit_ema(monthly(spark, d), "basin", "peak", 0.2, 0.3, low="single")


@query("ema_flows")
def ema_flows(spark, d):
    return pearson.flows_at(pearson.fit_ema(monthly(spark, d), "basin", "peak"), "basin", EXCEEDANCES)


@query("ema_periods")
def ema_periods(spark, d):
    m = monthly(spark, d)
    return pearson.chances_of(m, pearson.fit_ema(m, "basin", "peak"), "basin", "peak")


@query("lp3_percentiles")
def lp3_percentiles(spark, d):
    return pearson.flows_of_percentiles(frequency.fit_lp3(monthly(spark, d), "basin", "peak"), "basin", [0.1, 0.5, 0.9, 0.99])


@query("lp3_periods")
def lp3_periods(spark, d):
    m = monthly(spark, d)
    return pearson.chances_of(m, frequency.fit_lp3(m, "basin", "peak"), "basin", "peak")


@query("lp3_bins")
def lp3_bins(spark, d):
    return pearson.chance_of_bins(frequency.fit_lp3(monthly(spark, d), "basin", "peak"), "basin", [0.0, 1.0, 1.5, 2.0, 2.5, 3.0])


@query("unit_differences")
def unit_differences(spark, d):
    """Flows fitted in other units against those fitted in these: nothing but rounding may differ."""
    return pearson.unit_differences(monthly(spark, d), "basin", "peak", 0.0283168, [0.5, 0.1, 0.01])


_LOG = """x AS (SELECT basin, log10(peak) AS x FROM monthly WHERE peak > 0),
a AS (SELECT basin, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY 1),
g AS (SELECT basin, n, n / ((n - 1) * (n - 2))::DOUBLE * sum(((x - m) / s) ^ 3) AS skew FROM x JOIN a USING (basin) GROUP BY basin, n)"""


@query("skew_weights", f"""WITH {_LOG},
e AS (SELECT basin, skew, 10 ^ (CASE WHEN abs(skew) <= 0.9 THEN -0.33 + 0.08 * abs(skew) ELSE -0.52 + 0.3 * abs(skew) END - CASE WHEN abs(skew) <= 1.5 THEN 0.94 - 0.26 * abs(skew) ELSE 0.55 END * log10(n / 10.0)) AS mse FROM g)
SELECT basin, round(skew, 6) AS skew, round(mse, 6) AS mse, round((0.302 * skew + mse * 0.1) / (0.302 + mse), 6) AS weighted FROM e""", "flow monthly")
def skew_weights(spark, d):
    out = pearson.skew_weights(frequency.fit_lp3(monthly(spark, d), "basin", "peak"), "basin", 0.1, 0.302)
    return out.select("basin", *[R(c).alias(c) for c in ("skew", "mse", "weighted")])


VIEWS |= {"perceived": "SELECT basin, month, peak, CASE WHEN month % 3 = 0 THEN 300.0 WHEN month % 3 = 1 THEN 150.0 END::DOUBLE AS limit_ FROM monthly"}


@query("threshold_positions", """WITH t AS (SELECT basin, month, peak, coalesce(limit_, '-inf'::DOUBLE) AS l FROM perceived),
b AS (SELECT basin, l, row_number() OVER (PARTITION BY basin ORDER BY l DESC) AS band FROM (SELECT basin, l FROM t UNION SELECT basin, '-inf'::DOUBLE FROM t)),
v AS (SELECT t.*, min(b.band) AS band FROM t JOIN b ON t.basin = b.basin AND b.l <= t.peak GROUP BY ALL),
k AS (SELECT b.basin, b.band, b.l, (SELECT count(*) FROM v WHERE v.basin = b.basin AND v.band = b.band) AS k, (SELECT count(*) FROM v WHERE v.basin = b.basin AND v.l <= b.l AND v.band >= b.band) AS n FROM b),
s AS (SELECT *, CASE WHEN l = '-inf'::DOUBLE OR n <= 0 THEN 1.0 ELSE k / greatest(n, k)::DOUBLE END AS share FROM k WHERE k > 0),
p AS (SELECT *, coalesce(product(1 - share) OVER (PARTITION BY basin ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS rest FROM s)
SELECT basin, band, round(peak, 6) AS peak, round(1 - rest + rest * share * (row_number() OVER (PARTITION BY basin, band ORDER BY peak DESC) - 0.4) / (k + 0.2), 6) AS exceedance FROM v JOIN p USING (basin, band)""", "flow monthly perceived")
def threshold_positions(spark, d):
    month = F.col("month") % 3
    m = monthly(spark, d).withColumn("limit_", F.when(month == 0, 300.0).when(month == 1, 150.0))
    out = frequency.threshold_positions(m, "basin", "peak", "limit_", alpha=0.4)
    return out.select("basin", "band", R("peak").alias("peak"), R("exceedance").alias("exceedance"))
