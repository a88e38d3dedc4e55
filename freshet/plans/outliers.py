"""Queries on low outliers and on periods of flows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import frequency, outliers
from freshet.plans import base
from freshet.plans.base import VIEWS, query

R = lambda c, n=6: F.round(c, n)

VIEWS |= {"monthly": "SELECT basin, year(date) * 100 + month(date) AS month, greatest(max(q) - 40, 0)::DOUBLE AS peak FROM flow GROUP BY 1, 2"}


def monthly(spark, d):
    """Largest flow of each month above a base of 40; months that stay below it are zeros."""
    f = base.flow(spark, d).groupBy("basin", (F.year("date") * 100 + F.month("date")).alias("month")).agg(F.max("q").alias("q"))
    return f.select("basin", "month", F.greatest(F.col("q") - 40, F.lit(0)).cast("double").alias("peak"))


_TESTED = """x AS (SELECT basin, peak, CASE WHEN peak > 0 THEN log10(peak) END AS v, count(*) OVER (PARTITION BY basin) AS n, count(*) FILTER (peak = 0) OVER (PARTITION BY basin) AS z,
row_number() OVER (PARTITION BY basin ORDER BY peak DESC) AS down FROM monthly),
o AS (SELECT basin, peak, n, z, n - down + 1 AS r, v, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS std FROM x WINDOW w AS (PARTITION BY basin ORDER BY down ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("omega_statistics", f"""WITH {_TESTED}
SELECT basin, r, peak AS value, round(CASE WHEN r > n // 2 THEN NULL WHEN r < z THEN -sqrt((n - z) * (n - r - 1) / ((n - r) * (z - r))::DOUBLE) WHEN r > z THEN CASE WHEN std > 0 THEN (v - mean) / std ELSE 0 END END, 6) AS omega
FROM o WHERE n - z >= 5""", "flow monthly")
def omega_statistics(spark, d):
    return outliers.omega_statistics(monthly(spark, d), "basin", "peak").select("basin", "r", "value", R("omega").alias("omega"))


@query("multiple_grubbs_beck")
def multiple_grubbs_beck(spark, d):
    return outliers.multiple_grubbs_beck(monthly(spark, d), "basin", "peak")


@query("grubbs_beck", f"""WITH x AS (SELECT basin, peak, log10(peak) AS v, count(*) OVER (PARTITION BY basin) AS n, row_number() OVER (PARTITION BY basin ORDER BY peak DESC) AS size, rank() OVER (PARTITION BY basin ORDER BY peak) AS place FROM monthly WHERE peak > 0),
t AS (SELECT *, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS std FROM x WINDOW w AS (PARTITION BY basin ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT basin, coalesce(min(n - size + 1) FILTER (size >= 10 AND v >= mean - ({outliers.KN}::DOUBLE[])[least(size, 149) - 9] * std) - 1, min(n) - 9) AS k FROM t WHERE n >= 10 GROUP BY 1)
SELECT basin, CASE WHEN k > 0 THEN place - 1 ELSE 0 END AS n_low, CASE WHEN k > 0 THEN peak END AS threshold FROM t JOIN k USING (basin) WHERE n - size + 1 = k + 1""", "flow monthly")
def grubbs_beck(spark, d):
    return outliers.grubbs_beck(monthly(spark, d), "basin", "peak")


@query("gumbel_periods", f"""WITH f AS (SELECT basin, avg(peak) AS mean, stddev_samp(peak) AS std FROM monthly GROUP BY 1 HAVING count(*) >= 8 AND avg(peak) > 1e-3)
SELECT basin, month, peak, round(1 / (1 - exp(-exp(-(pi() / sqrt(6) * (peak - mean) / nullif(std, 0) + {frequency.EULER})))), 4) AS period FROM monthly LEFT JOIN f USING (basin)""", "flow monthly")
def gumbel_periods(spark, d):
    m = monthly(spark, d)
    return frequency.gumbel_periods(m, frequency.fit_gumbel(m, "basin", "peak"), "basin", "peak").withColumn("period", R("period", 4))


_LINE = """p AS (SELECT basin, log10(peak) AS x, log10(-log10(row_number() OVER (PARTITION BY basin ORDER BY peak DESC, year) / (count(*) OVER (PARTITION BY basin) + 1.0::DOUBLE))) AS y FROM (SELECT basin, month AS year, peak FROM monthly WHERE peak > 0)),
f AS (SELECT basin, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM p GROUP BY 1)"""


@query("loglog_periods", f"""WITH {_LINE} SELECT basin, month, peak, round(CASE WHEN peak > 0 THEN 10 ^ (10 ^ (intercept + slope * log10(peak))) END, 3) AS period FROM monthly LEFT JOIN f USING (basin)""", "flow monthly")
def loglog_periods(spark, d):
    m = monthly(spark, d)
    fit = frequency.fit_loglog(m.withColumnRenamed("month", "year"), "basin", "peak")
    return frequency.loglog_periods(m, fit, "basin", "peak").withColumn("period", R("period", 3))


@query("loglog_flows", f"""WITH {_LINE} SELECT basin, t AS period, round(10 ^ ((log10(log10(t)) - intercept) / slope), 3) AS flow FROM f, (SELECT unnest([2.0, 10.0, 100.0])::DOUBLE AS t)""", "flow monthly")
def loglog_flows(spark, d):
    fit = frequency.fit_loglog(monthly(spark, d).withColumnRenamed("month", "year"), "basin", "peak")
    return frequency.loglog_flows(fit, "basin", [2, 10, 100]).withColumn("flow", R("flow", 3))
