"""Gridded values to basin values: weighted means with a coverage rule, ensembles, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a basin's weight that must be valid, and the slack of that comparison.
COVERAGE, SLACK = 0.80, 1e-6


def from_nan(column: str | Column) -> Column:
    """NaN as NULL; missing is NULL everywhere in this library."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c), c)


def normalised_weights(cells: DataFrame, size: str, key: str = "basin") -> DataFrame:
    """Adds weight: a cell's share of its basin's sizes."""
    return cells.withColumn("weight", F.try_divide(F.col(size), F.sum(size).over(Window.partitionBy(key))))


def zonal_reduce(grid: DataFrame, weights: DataFrame, by: list[str], value: str = "value", cell=("lat_idx", "lon_idx"), more: dict[str, Column] | None = None, slack: float = SLACK) -> DataFrame:
    """Per basin and `by`: the weighted mean of valid cells, NULL under the coverage rule, and the missing fraction.

    The weights decide what a basin's whole weight is, so cells without a row count as missing. The join is an equi-join on the cell;
    the aggregation has partial sums before its one shuffle. `more` are further aggregates of the joined cells.
    """
    whole = weights.groupBy("basin").agg(F.sum("weight").alias("_whole"))
    joined = grid.join(weights, list(cell))
    valid = F.col(value).isNotNull()
    sums = joined.groupBy("basin", *by).agg(
        F.sum(F.when(valid, F.col("weight") * F.col(value))).alias("_wx"), F.coalesce(F.sum(F.when(valid, F.col("weight"))), F.lit(0.0)).alias("_w"),
        *[x.alias(name) for name, x in (more or {}).items()],
    )
    share = F.try_divide(F.col("_w"), F.col("_whole"))
    return sums.join(whole, "basin").select(
        "basin", *by, F.when(share >= COVERAGE - slack, F.try_divide(F.col("_wx"), F.col("_w"))).alias(value), F.greatest(F.lit(0.0), 1 - share).alias("missing_fraction"), *(more or {})
    )


def basin_summary(grid: DataFrame, weights: DataFrame, by: list[str], value: str = "value", cell=("lat_idx", "lon_idx")) -> DataFrame:
    """zonal_reduce with the largest cell beside the mean."""
    return zonal_reduce(grid, weights, by, value, cell, {"max_cell": F.max(value)})


def ensemble_stats(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Over members with a value: mean, sample deviation (two members or more), extremes and exact deciles."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy(*by).agg(F.count(value).alias("members"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_q"))
    return out.select(*by, "members", "mean", F.when(F.col("members") >= 2, F.col("std")).alias("std"), "min", "max", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def member_percentiles(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Minimum, quartiles, maximum and mean of members that aren't negative; steps without one are left out."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = df.where(F.col(value) >= 0).groupBy(*by).agg(q.alias("_q"), F.avg(value).alias("mean"))
    return out.select(*by, "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(("min", "p25", "p50", "p75", "max"))])


def daily_mean(df: DataFrame, key: list[str], t: str, value: str) -> DataFrame:
    """Sub-daily to daily means over valid values."""
    return df.groupBy(*key, F.to_date(t).alias("date")).agg(F.avg(value).alias(value))


def daily_sum_complete(df: DataFrame, key: list[str], t: str, value: str, n_expected: int = 48, step_hours: float = 0.5) -> DataFrame:
    """Daily sums of rate x step; missing unless n_expected different slots of the day have a valid rate."""
    slot = F.floor((F.hour(t) * 60 + F.minute(t)) / (step_hours * 60))
    slots = df.groupBy(*key, F.to_date(t).alias("date"), slot.alias("_slot")).agg(F.avg(value).alias("_v"))
    return slots.groupBy(*key, "date").agg(F.when(F.count("_v") == n_expected, F.sum("_v") * step_hours).alias("total"), F.count("_v").alias("slots"))


def combine_missing(df: DataFrame, value: str, fractions: list[str]) -> Column:
    """The largest of several missing fractions; 1 where the value itself is missing."""
    return F.when(F.col(value).isNull(), F.lit(1.0)).otherwise(F.greatest(*[F.coalesce(F.col(c), F.lit(1.0)) for c in fractions]) if len(fractions) > 1 else F.col(fractions[0]))


def plane_completeness(df: DataFrame, run: str, lead: str, value: str, allowed: float = 0.01) -> DataFrame:
    """Valid cells of each lead of a run against its first lead; deficient if more than `allowed` of them lack."""
    counts = df.groupBy(run, lead).agg(F.count(value).alias("cells"))
    first = F.first("cells").over(Window.partitionBy(run).orderBy(lead))
    return counts.withColumn("first_cells", first).withColumn("deficient", F.col("cells") < (1 - allowed) * F.col("first_cells"))


def bin_average(df: DataFrame, lat: str, lon: str, value: str, degrees: float = 0.25, by: list[str] = ()) -> DataFrame:
    """Points averaged onto the cells of a regular grid."""
    return df.groupBy(*by, F.floor((F.col(lat) + 90) / degrees).alias("lat_idx"), F.floor((F.col(lon) + 180) / degrees).alias("lon_idx")).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def daily_from_steps(df: DataFrame, key: list[str], step: str, state: str, accumulated: str) -> DataFrame:
    """Lead days of hourly steps: states averaged, accumulations taken at the day's last step and then differenced."""
    days = df.withColumn("lead_day", (F.floor((F.col(step) - 1) / 24) + 1).cast("int")).groupBy(*key, "lead_day").agg(F.avg(state).alias(state), F.max_by(accumulated, step).alias("_a"))
    before = F.lag("_a").over(Window.partitionBy(*key).orderBy("lead_day"))
    return days.withColumn(accumulated, F.col("_a") - F.coalesce(before, F.lit(0.0))).drop("_a")


def area_weighted_mean(df: DataFrame, key: str, weight: str, value: str, sentinel: float = -900) -> DataFrame:
    """Weighted mean of values above the sentinel."""
    good = df.where(F.col(value) > sentinel)
    return good.groupBy(key).agg(F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(weight)).alias("mean"))


def weighted_majority(df: DataFrame, key: str, weight: str, label: str) -> DataFrame:
    """The class with the largest sum of weights, the lowest class of a tie."""
    sums = df.groupBy(key, label).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(key).agg(F.max_by(label, F.struct("_w", (-F.col(label)).alias("_low"))).alias("majority"))


def coverage_fraction(df: DataFrame, key: str, used: Column, area: str) -> DataFrame:
    """Share of a basin's fragments' area that is used, and their whole area."""
    return df.groupBy(key).agg(F.try_divide(F.sum(F.when(used, F.col(area)).otherwise(0.0)), F.sum(area)).alias("coverage"), F.sum(area).alias("area"))


def requested_mean(df: DataFrame, key: str, weight: str, value: str, least: float = 0.8) -> DataFrame:
    """The weighted mean of the values that are there; NULL if they have less than the least share of the requested weight."""
    have = F.when(F.col(value).isNotNull(), F.col(weight))
    out = df.groupBy(key).agg(F.sum(have).alias("_h"), F.sum(weight).alias("_w"), F.sum(have * F.col(value)).alias("_s"))
    return out.select(key, F.when(F.try_divide("_h", "_w") >= least, F.try_divide("_s", "_h")).alias("value"))
