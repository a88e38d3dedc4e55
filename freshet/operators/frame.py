"""Projections, filters, joins, sequences and set operations on basin tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_least(c: Column, low: float) -> Column:
    """c clipped below; NULL stays NULL (greatest alone would give the bound)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def apply_band_transform(df: DataFrame, column: str, scale: float = 1.0, offset: float = 0.0, low: float | None = None) -> DataFrame:
    c = F.col(column) * scale + offset
    return df.withColumn(column, c if low is None else at_least(c, low))


def temp_to_celsius(df: DataFrame, column: str, series: list[str], units: str | None = None) -> DataFrame:
    """Kelvin to Celsius: by the unit's name, or without one for series whose mean is above 150."""
    kelvin = F.lit(units.upper().startswith("K")) if units else F.avg(column).over(Window.partitionBy(*series)) > 150
    return df.withColumn(column, F.when(kelvin, F.col(column) - 273.15).otherwise(F.col(column)))


def normalise_pet_sign(df: DataFrame, column: str, series: list[str]) -> DataFrame:
    """Series of negative mean with the sign turned."""
    return df.withColumn(column, F.when(F.avg(column).over(Window.partitionBy(*series)) < 0, -F.col(column)).otherwise(F.col(column)))


def specific_discharge(q: Column, area_km2: Column) -> Column:
    """m3/s to mm/day over the area."""
    return F.try_divide(q * 86.4, area_km2)


def cubic_feet(q: Column) -> Column:
    """m3/s to ft3/s."""
    return q / 0.028316846592


def parse_finite(c: Column) -> Column:
    """A number by a strict grammar; anything else, and what isn't finite, is NULL."""
    return F.when(F.trim(c).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(c).try_cast("double"))


def filter_bbox(df: DataFrame, west: float, south: float, east: float, north: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points in an inclusive box; west > east crosses the antimeridian, which gives two ranges. Both reach the scan."""
    inside = F.col(lon).between(west, east) if west <= east else (F.col(lon) >= west) | (F.col(lon) <= east)
    return df.where(F.col(lat).between(south, north) & inside)


def filter_period(df: DataFrame, t: str, ranges: list[tuple[str, str]]) -> DataFrame:
    """Rows in the union of inclusive date ranges."""
    for a, b in ranges:
        if a >= b:
            raise ValueError("a range begins before it ends")
    return df.where(reduce(lambda x, y: x | y, [F.col(t).between(F.to_date(F.lit(a)), F.to_date(F.lit(b))) for a, b in ranges]))


def filter_catalog(df: DataFrame, box: tuple, min_area: float, limit: int, key: str = "point_id") -> DataFrame:
    """The largest entries in a box with at least min_area: a top-k report."""
    return filter_bbox(df, *box).where(F.col("area") >= min_area).orderBy(F.col("area").desc(), key).limit(limit)


def skip_all_missing(df: DataFrame, key: str, t: str, value: str, ranges: list[tuple[str, str]]) -> DataFrame:
    """Rows of the entities with a valid value in the ranges."""
    seen = filter_period(df, t, ranges).where(F.col(value).isNotNull()).select(key).distinct()
    return df.join(seen, key, "left_semi")


def densify_daily(df: DataFrame, key: str, t: str) -> DataFrame:
    """Each series on all days from its first to its last; new days have NULLs."""
    ends = df.groupBy(key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    days = ends.select(key, F.explode(F.sequence("_a", "_b")).alias(t))
    return days.join(df, [key, t], "left")


def merge_features(dfs: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full"), dfs)


def attach_forecast_by_valid_date(obs: DataFrame, forecasts: DataFrame, key: str = "basin") -> DataFrame:
    """Observations with the forecasts valid on their day: lead k issued on D is valid on D + k - 1."""
    valid = forecasts.withColumn("valid_date", F.date_add("issue", F.col("lead") - 1)).select(key, F.col("valid_date").alias("date"), "issue", "lead", "forecast")
    return obs.join(valid, [key, "date"])


def first_store_wins(dfs: list[DataFrame], key: str) -> DataFrame:
    """Columns of several stores side by side; of a name that occurs twice the first store's stays."""
    out, seen = None, {key}
    for df in dfs:
        own = df.select(key, *[c for c in df.columns if c not in seen])
        seen.update(own.columns)
        out = own if out is None else out.join(own, key, "left")
    return out


def align_canonical(frame: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """The reference's values on the frame's keys."""
    return frame.select(*keys).join(reference, keys, "left")


def merge_best_coverage(old: DataFrame, new: DataFrame, keys: list[str], value: str, fraction: str, margin: float = 1e-5) -> DataFrame:
    """new instead of old where it is valid and old is missing, of unknown coverage, or less complete by more than margin."""
    a = old.select(*keys, F.col(value).alias("_v0"), F.col(fraction).alias("_f0"))
    b = new.select(*keys, F.col(value).alias("_v1"), F.col(fraction).alias("_f1"))
    better = F.col("_v1").isNotNull() & (F.col("_v0").isNull() | F.col("_f0").isNull() | (F.col("_f1") < F.col("_f0") - margin))
    return a.join(b, keys, "full").select(*keys, F.when(better, F.col("_v1")).otherwise(F.col("_v0")).alias(value), F.when(better, F.col("_f1")).otherwise(F.col("_f0")).alias(fraction))


def carry_forward(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and old's rows of the keys that new lacks."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def update_columns(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the named columns from updates, missing where there is none."""
    return base.drop(*columns).join(updates.select(key, *columns), key, "left")


def select_source_by_priority(dfs: list[DataFrame], key: str) -> DataFrame:
    """For each key the rows of the first source that has it."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(dfs)])
    best = tagged.groupBy(key).agg(F.min("source_rank").alias("source_rank"))
    return tagged.join(best, [key, "source_rank"])


def dedupe_max(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """One row for each key: the largest value, the lowest tie."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc(), F.col(tie))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def deaccumulate(df: DataFrame, key: list[str], t: str, value: str, clip: bool = True) -> DataFrame:
    """Differences of an accumulated series; the first value stays."""
    d = F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*key).orderBy(t)), F.lit(0.0))
    return df.withColumn(value, at_least(d, 0.0) if clip else d)


def spells(df: DataFrame, key: str, t: str, condition: Column) -> DataFrame:
    """Runs of consecutive rows on which the condition holds: number, mean and longest length per key."""
    whole, true = Window.partitionBy(key).orderBy(t), Window.partitionBy(key, "_c").orderBy(t)
    marked = df.withColumn("_c", F.coalesce(condition, F.lit(False)))
    islands = marked.withColumn("_g", F.row_number().over(whole) - F.row_number().over(true)).where("_c")
    runs = islands.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("spells"), F.avg("_n").alias("mean_length"), F.max("_n").alias("longest"))


def up_crossings(df: DataFrame, key: str, t: str, value: str, threshold: Column) -> Column:
    """True where a series rises to the threshold: the first row if it is there, else one whose predecessor is validly below."""
    w = Window.partitionBy(key).orderBy(t)
    before = F.lag(value).over(w)
    return F.coalesce((F.col(value) >= threshold) & F.when(F.row_number().over(w) == 1, F.lit(True)).otherwise(before < threshold), F.lit(False))


def cumulative(df: DataFrame, key: list[str], t: str, amount: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(amount).over(Window.partitionBy(*key).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)))


def sequence_valid(mask: Column, key: str, t: str, length: int, shift: int = 0, every: bool = True) -> Column:
    """Whether the window of `length` rows that ends `shift` rows on is all (or anywhere) true; false where it is cut off."""
    if length <= 0:
        return F.lit(True)
    w = Window.partitionBy(key).orderBy(t).rowsBetween(shift - length + 1, shift)
    one = F.coalesce(mask, F.lit(False)).cast("int")
    return (F.count(F.lit(1)).over(w) == length) & ((F.min(one) if every else F.max(one)).over(w) == 1)


def window_peak(df: DataFrame, key: str, t: str, value: str, today: str) -> DataFrame:
    """The peak on or after today, or else of the whole series; the earliest of a tie."""
    score = F.struct(F.col(t) >= F.to_date(F.lit(today)), F.col(value), F.datediff(F.lit("1900-01-01"), F.col(t)))
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(F.struct(F.col(t), F.col(value)), score).alias("_p")).select(key, F.col("_p")[t].alias("peak_date"), F.col("_p")[value].alias("peak"))


def last_valid_date(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """The latest day on which every key has a valid value."""
    keys = df.select(key).distinct().agg(F.count(F.lit(1)).alias("_keys"))
    days = df.where(F.col(value).isNotNull()).groupBy(t).agg(F.count_distinct(key).alias("_n"))
    return days.crossJoin(F.broadcast(keys)).where("_n = _keys").agg(F.max(t).alias("last_valid"))


def latency(df: DataFrame, key: str, t: str, value: str, issue: str) -> DataFrame:
    """The last valid day and the days that lack from there to the issue date."""
    return df.groupBy(key).agg(F.max(F.when(F.col(value).isNotNull(), F.col(t))).alias("last_valid")).withColumn("missing_days", F.datediff(F.to_date(F.lit(issue)), "last_valid"))


def flow_duration(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values with rank and exceedance, largest first, missing last."""
    w = Window.partitionBy(key).orderBy(F.col(value).desc_nulls_last())
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("rank", F.row_number().over(w)).withColumn("exceedance", F.col("rank") / (n + 1))


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """n rows of each stratum by the MD5 of their key: a sampling operator."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def percentile_profile(df: DataFrame, by: list[str], value: str, shares=(0.0, 0.01, 0.05, 0.1, 0.25, 0.5)) -> DataFrame:
    out = df.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(s)) for s in shares])).alias("_q"))
    return out.select(*by, *[F.col("_q")[i].alias(f"p{s * 100:g}") for i, s in enumerate(shares)])


#: Steps of a feature's range among which the one that holds its median is found.
MEDIAN_STEPS = 4096


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, population deviation, extremes and exact median of each feature.

    No task sees a whole column: values are counted by steps of the feature's range, then those of the one or two
    steps that hold the middle ranks are counted by value.
    """
    long = df.unpivot([], features, "feature", "v").where("v IS NOT NULL")
    stats = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))
    step = F.coalesce(F.least(F.lit(MEDIAN_STEPS - 1), F.floor(F.try_divide(F.col("v") - F.col("min"), F.col("max") - F.col("min")) * MEDIAN_STEPS)), F.lit(0))
    stepped = long.join(F.broadcast(stats.select("feature", "min", "max", "n")), "feature").select("feature", "v", "n", step.cast("int").alias("step"))  # a row for each named feature
    w = Window.partitionBy("feature").orderBy("step")
    counts = stepped.groupBy("feature", "step", "n").agg(F.count(F.lit(1)).alias("k")).withColumn("to", F.sum("k").over(w)).withColumn("before", F.col("to") - F.col("k"))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("to"))
    middle = counts.where(holds(low) | holds(high)).select("feature", "step", "before")
    values = stepped.join(F.broadcast(middle), ["feature", "step"]).groupBy("feature", "step", "v", "n", "before").agg(F.count(F.lit(1)).alias("k"))
    ranked = values.withColumn("to", F.col("before") + F.sum("k").over(Window.partitionBy("feature", "step").orderBy("v"))).withColumn("before", F.col("to") - F.col("k"))
    found = ranked.where(holds(low) | holds(high))
    median = found.groupBy("feature").agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"))
    empty = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in features])).alias("feature"))
    return empty.join(stats.drop("n"), "feature", "left").join(median, "feature", "left")


def scaled(df: DataFrame, scaler: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """(x - mean) / std of each feature, long; a scale of 0 is an error."""
    long = df.unpivot(key, features, "feature", "v")
    std = F.when(F.col("std") > 0, F.col("std")).otherwise(F.raise_error(F.lit("a feature has no spread")).cast("double"))
    return long.join(F.broadcast(scaler.select("feature", "mean", std.alias("std"))), "feature").select(*key, "feature", ((F.col("v") - F.col("mean")) / F.col("std")).alias("z"))  # a row for each named feature


def severity_trend(df: DataFrame, key: str, t: str, value: str, band: float = 0.05) -> DataFrame:
    """Peak and trend of a forecast: rising or falling if the mean of the last third leaves that of the first by over 5 %."""
    w = Window.partitionBy(key)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(t))
    third = F.greatest(F.lit(1), F.floor(n / 3))
    marked = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), (i <= third).alias("_head"), (i > n - third).alias("_tail"))
    out = marked.groupBy(key).agg(F.max("_v").alias("peak"), F.avg(F.when(F.col("_head"), F.col("_v"))).alias("head"), F.avg(F.when(F.col("_tail"), F.col("_v"))).alias("tail"))
    trend = F.when(F.col("tail") > F.col("head") * (1 + band), "rising").when(F.col("tail") < F.col("head") * (1 - band), "falling").otherwise("steady")
    return out.select(key, "peak", trend.alias("trend"))


def rebin_rates(df: DataFrame, keys: list[str], begin: str, end: str, rate: str, width: int) -> DataFrame:
    """Interval-mean rates to intervals of `width`; only those that the given intervals cover wholly."""
    bins = df.where(F.col(rate).isNotNull()).withColumn("_k", F.explode(F.sequence(F.floor(F.col(begin) / width), F.ceil(F.col(end) / width) - 1)))
    inside = F.least(F.col(end), (F.col("_k") + 1) * width) - F.greatest(F.col(begin), F.col("_k") * width)
    out = bins.groupBy(*keys, "_k").agg(F.sum(inside).alias("_h"), (F.sum(inside * F.col(rate)) / width).alias(rate))
    return out.where(F.col("_h") == width).select(*keys, (F.col("_k") * width).alias(begin), rate)


#: What a unit of rain is in mm an hour, units of the other streams, and what is taken off stored pressures.
RAIN_UNITS = {"kg m-2 s-1": 3600.0, "kg m**-2 s**-1": 3600.0, "mm/s": 3600.0, "mm s-1": 3600.0, "mm/h": 1.0, "mm/hr": 1.0, "mm h-1": 1.0, "mm/day": 1 / 24, "mm/d": 1 / 24, "mm day-1": 1 / 24}
KELVIN, CELSIUS = ["K", "kelvin", "degK", "deg_K"], ["degC", "deg_C", "C", "celsius", "degree_Celsius", "degrees_Celsius"]
PASCAL, HECTOPASCAL, WIND_UNITS = ["Pa", "pa", "pascal"], ["hPa", "hpa", "mbar", "millibar"], ["m/s", "m s-1", "m s**-1", "m/sec"]
PRESSURE_OFFSET = 1000.0


def to_stored_units(stream: Column, v: Column, units: Column, mean: Column) -> Column:
    """A value as its stream stores it: precip in mm/h and not below 0, mslp in hPa less 1000, temp in degrees Celsius, u10 and v10 in m/s.

    Without units rain is in kg m-2 s-1, pressure in Pa, and temperature in kelvin if `mean`, that of its field, is above 150. Missing
    values stay missing; streams and units that aren't known are errors.
    """
    wrong = F.raise_error(F.concat(F.lit("no such stream or unit: "), stream, F.lit(" "), F.coalesce(units, F.lit("")))).cast("double")
    one_of = lambda names: units.isin(*names)
    factor = F.coalesce(*[F.when(units == u, F.lit(f)) for u, f in RAIN_UNITS.items()], F.when(units.isNull(), F.lit(3600.0)), wrong)
    pressure = F.when(units.isNull() | one_of(PASCAL), v / 100).when(one_of(HECTOPASCAL), v).otherwise(wrong) - PRESSURE_OFFSET
    kelvin = F.when(units.isNull(), F.coalesce(mean > 150, F.lit(False))).when(one_of(KELVIN), True).when(one_of(CELSIUS), False)
    temperature = F.when(kelvin.isNull(), wrong).when(kelvin, v - 273.15).otherwise(v)
    wind = F.when(units.isNull() | one_of(WIND_UNITS), v).otherwise(wrong)
    known = F.when(stream == "precip", F.greatest(F.lit(0.0), v) * factor).when(stream == "mslp", pressure).when(stream == "temp", temperature).when(stream.isin("u10", "v10"), wind).otherwise(wrong)
    return F.when(v.isNotNull(), known)


def from_stored_units(stream: Column, v: Column, offset: float = PRESSURE_OFFSET) -> Column:
    """Physical values of stored ones: pressures get their offset back, temperatures stay in degrees Celsius."""
    return F.when(stream == "mslp", v + offset).otherwise(v)


def to_physical_units(df: DataFrame, scales: dict[str, float], columns: list[str], strict: bool = True) -> DataFrame:
    """columns by their registered scales; one that isn't registered is an error if strict, else it stays."""
    if strict and (unknown := [c for c in columns if c not in scales]):
        raise ValueError(f"no scale for {unknown}")
    return df.withColumns({c: F.col(c) * F.lit(float(scales[c])) for c in columns if c in scales})


def flip_shift_grid(df: DataFrame, lon: str, value: str) -> DataFrame:
    """Longitudes of 0 to 360 as -180 to 180, negative values as missing."""
    return df.withColumn(lon, F.when(F.col(lon) >= 180, F.col(lon) - 360).otherwise(F.col(lon))).withColumn(value, F.when(F.col(value) >= 0, F.col(value)))


def subdataset(basin: Column) -> Column:
    """What precedes the first underscore of a basin's id."""
    return F.split_part(basin, F.lit("_"), F.lit(1))


def link_id(number: Column) -> Column:
    """The nine digits of a link."""
    return F.lpad((number % 1_000_000_000).cast("string"), 9, "0")


def safe_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")
