"""Climate indices of daily series and lead-day aggregation of irregular forecast steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def climate_indices(daily: DataFrame, key: str = "basin", t: str = "date", p: str = "p", pet: str = "pet", temp: str = "temp") -> DataFrame:
    """Means, aridity, moisture index and its seasonality, snow share, and frequency and duration of wet and dry spells.

    Moisture of a month is 1 - pet/p, or p/pet - 1 if pet is larger; its mean over months is the index and its range
    the seasonality. Snow is the share of a mean year's rain that falls in months of mean temperature at most 0.
    High rain is at least five times the mean, low rain below 1 mm. Everything is rounded to four places.
    """
    whole = Window.partitionBy(key)
    months = daily.groupBy(key, F.month(t).alias("_m")).agg(F.avg(p).alias("_p"), F.avg(pet).alias("_e"), F.avg(temp).alias("_t"))
    moisture = F.when(F.col("_p") > F.col("_e"), 1 - F.try_divide(F.col("_e"), F.col("_p"))).when(F.col("_p") < F.col("_e"), F.try_divide(F.col("_p"), F.col("_e")) - 1).otherwise(0.0)
    yearly = months.withColumn("_i", moisture).groupBy(key).agg(
        F.avg("_i").alias("moisture_index"), (F.max("_i") - F.min("_i")).alias("seasonality"), F.try_divide(F.sum(F.when(F.col("_t") <= 0, F.col("_p")).otherwise(0.0)), F.sum("_p")).alias("frac_snow")
    )
    means = daily.groupBy(key).agg(F.avg(p).alias("p_mean"), F.avg(pet).alias("pet_mean")).withColumn("aridity", F.try_divide(F.col("pet_mean"), F.col("p_mean")))
    marked = daily.select(key, t, (F.col(p) >= 5 * F.avg(p).over(whole)).alias("high"), (F.col(p) < 1).alias("low")).unpivot([key, t], ["high", "low"], "kind", "on")
    order = F.row_number().over(Window.partitionBy(key, "kind").orderBy(t)) - F.row_number().over(Window.partitionBy(key, "kind", "on").orderBy(t))
    runs = marked.where("on IS NOT NULL").withColumn("_g", order).where("on").groupBy(key, "kind", "_g").agg(F.count(F.lit(1)).alias("_n"))
    days = daily.groupBy(key).agg(F.count(p).alias("_days"))
    spells = runs.groupBy(key, "kind").agg(F.sum("_n").alias("_on"), F.avg("_n").alias("dur")).join(days, key).withColumn("freq", F.try_divide(F.col("_on"), F.col("_days")))
    wide = spells.groupBy(key).pivot("kind", ["high", "low"]).agg(F.first("freq").alias("freq"), F.first("dur").alias("dur"))
    out = means.join(yearly, key).join(wide, key, "left")
    names = [c for c in out.columns if c != key]
    return out.select(key, *[F.round(F.coalesce(F.col(c), F.lit(0.0)) if c[:4] in ("high", "low_") else F.col(c), 4).alias(c) for c in names])


def zonal_climatology(grid: DataFrame, weights: DataFrame, bands: dict[str, str], t: str = "date", first: str | None = None, last: str | None = None) -> DataFrame:
    """climate_indices of basins from daily grids (t, lat_idx, lon_idx, bands): bands name the columns of p, pet and temp.

    A basin's day counts where cells of 80 % of its weight have a value, without slack; the years can be those of a
    baseline. All bands are reduced by one join of the grid with the weights, cell by cell; no grid is held whole.
    """
    days = grid if first is None else grid.where(F.year(t).between(int(first), int(last)))
    whole = weights.groupBy("basin").agg(F.sum("weight").alias("_whole"))
    met = days.join(weights, ["lat_idx", "lon_idx"])
    sums = met.groupBy("basin", t).agg(*[x for name, c in bands.items() for x in (F.sum(F.when(F.col(c).isNotNull(), F.col("weight"))).alias(f"_w{name}"), F.sum(F.col("weight") * F.col(c)).alias(f"_s{name}"))])
    value = lambda name: F.when(F.try_divide(F.col(f"_w{name}"), F.col("_whole")) >= 0.8, F.try_divide(F.col(f"_s{name}"), F.col(f"_w{name}")))
    daily = sums.join(whole, "basin").select("basin", t, *[value(name).alias(name) for name in bands])
    return climate_indices(daily, "basin", t)


def daily_lead_aggregate(df: DataFrame, keys: list[str], lead_hours: str, value: str, mode: str = "mean") -> DataFrame:
    """Irregular forecast steps to lead days, only those that the steps tile exactly.

    A step reaches from the step before it (0 for the first) to its own lead. `rate_sum` adds rate x hours, `mean`
    weighs by hours, `min` and `max` are plain; `trapz` averages linearly between steps, and a step on a day's
    boundary belongs to both days. A step that crosses a boundary tiles neither day.
    """
    w = Window.partitionBy(*keys).orderBy(lead_hours)
    steps = df.withColumn("_from", F.coalesce(F.lag(lead_hours).over(w), F.lit(0))).withColumn("_before", F.lag(value).over(w))
    steps = steps.withColumn("_h", F.col(lead_hours) - F.col("_from")).withColumn("lead_day", (F.floor(F.col("_from") / 24) + 1).cast("int"))
    inside = F.ceil(F.col(lead_hours) / 24) == F.col("lead_day")
    v = F.col(value)
    expression = {
        "rate_sum": F.sum(v * F.col("_h")), "mean": F.sum(v * F.col("_h")) / 24, "min": F.min(v), "max": F.max(v),
        "trapz": F.sum((v + F.coalesce(F.col("_before"), v)) / 2 * F.col("_h")) / 24,
    }[mode]
    tiled = F.sum(F.when(inside & v.isNotNull(), F.col("_h")).otherwise(0)) == 24
    return steps.groupBy(*keys, "lead_day").agg(F.when(tiled & F.bool_and(inside), expression).alias(value)).where(F.col(value).isNotNull())
