"""Sample moments and their errors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_moments(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """n, mean, sample deviation and the unbiased skew n / ((n-1)(n-2)) sum z^3."""
    x = df.select(*by, value.alias("_x")).where(F.col("_x").isNotNull())
    mean = F.avg("_x").over(Window.partitionBy(*by))
    m = x.withColumn("_d", F.col("_x") - mean).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.sum(F.col("_d") ** 3).alias("_c"))
    n = F.col("n")
    skew = F.when((n >= 3) & (F.col("std") > 0), n / ((n - 1) * (n - 2)) * F.col("_c") / F.col("std") ** 3)
    return m.select(*by, "n", "mean", "std", skew.alias("skew"))


def station_skew_mse(skew: Column, n: Column) -> Column:
    """Mean squared error of a station's skew (bulletin 17B)."""
    g = F.abs(skew)
    a = F.when(g <= 0.90, -0.33 + 0.08 * g).otherwise(-0.52 + 0.30 * g)
    b = F.when(g <= 1.50, 0.94 - 0.26 * g).otherwise(F.lit(0.55))
    return F.pow(F.lit(10.0), a - b * F.log10(n / 10.0))


def weighted_skew(skew: Column, mse: Column, regional: float, regional_mse: float) -> Column:
    return (regional_mse * skew + mse * regional) / (regional_mse + mse)
