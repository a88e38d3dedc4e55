"""Training samples of series: validity masks, windows, filled features, date splits, run planning."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.frame import sequence_valid


def group_mask(groups: list[list[str]], method: str) -> Column:
    """Whether a row's feature groups are usable: none (all features), input_replacing (any), masked_mean or attention
    (any group wholly), unioning (one of every group)."""
    valid = [[F.col(c).isNotNull() for c in g] for g in groups]
    every = lambda xs: reduce(lambda a, b: a & b, xs)
    some = lambda xs: reduce(lambda a, b: a | b, xs)
    if method == "none":
        return every([every(g) for g in valid])
    if method == "input_replacing":
        return some([some(g) for g in valid])
    if method in ("masked_mean", "attention"):
        return some([every(g) for g in valid])
    if method == "unioning":
        return every([some(g) for g in valid])
    raise ValueError(f"no such method: {method}")


def valid_samples(df: DataFrame, key: str, t: str, hindcast: Column, target: Column, length: int, leads: int, static: Column, begin: str, end: str) -> DataFrame:
    """(key, t) of the days of a daily series on which a sample can be issued: static values are there, the hindcast is valid on
    all `length` days that end there, the target on one of the `leads` days that begin there at least, within the period."""
    marked = df.withColumn("_h", sequence_valid(hindcast, key, t, length)).withColumn("_t", sequence_valid(target, key, t, leads, leads - 1, every=False))
    return marked.where(F.col("_h") & F.col("_t") & static & F.col(t).between(begin, end)).select(key, t)


def sample_windows(df: DataFrame, key: str, t: str, value: str, length: int, leads: int) -> DataFrame:
    """For each day of a daily series the `length` values that end there and the `leads` values that follow; missing ones stay NULL.

    Days whose windows are cut off have no sample.
    """
    w = Window.partitionBy(key).orderBy(t)
    kept = lambda span: F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(span), lambda x: x["v"])
    out = df.select(key, t, kept(w.rowsBetween(1 - length, 0)).alias("x"), kept(w.rowsBetween(1, leads)).alias("y"))
    return out.where((F.size("x") == length) & (F.size("y") == leads))


def union_by_valid_date(forecast: DataFrame, daily: DataFrame, key: str, issue: str, lead: str, value: str, fill: str) -> DataFrame:
    """Missing forecast values from the daily feature at the valid date, issue + lead - 1."""
    own = daily.select(key, F.col(issue).alias("_valid"), F.col(fill).alias("_fill"))
    return forecast.withColumn("_valid", F.date_add(issue, F.col(lead) - 1)).join(own, [key, "_valid"], "left").withColumn(value, F.coalesce(value, "_fill")).drop("_valid", "_fill")


#: Fixed values of the split: least days of a sequence, least sample days, bounds of the share.
LEAST_SEQUENCE, LEAST_DAYS, SHARES = 8, 4, (0.2, 0.9)


def partition_dates(df: DataFrame, key: str, t: str, share: float, lead_time: int, sequence: int, last_n: int | None = None) -> DataFrame:
    """Train and validation dates of each series for samples of `sequence` days that predict `lead_time` days ahead.

    (key, days, sequence, shortened, train_days, validation_days, train_from, train_to, valid_from, valid_to). The first
    sample needs `sequence` days before it, the last one lead_time after it; targets reach `horizon` days (the larger of lead_time and
    last_n), so that many days lie between the last training date and the first of validation. Short records get shorter
    sequences, down to the larger of LEAST_SEQUENCE and the horizon. The share is taken as the decimal number that is
    written, so that 45 days at 0.7 are 31.5 and not a little less. Series too short for both parts have NULL dates.
    """
    if not SHARES[0] <= share <= SHARES[1] or min(lead_time, sequence, last_n or 1) < 1:
        raise ValueError("the share is out of range, or a length isn't positive")
    horizon = max(lead_time, last_n or lead_time)
    least = max(LEAST_SEQUENCE, horizon)
    own = df.select(key, t).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(t)) - 1).withColumn("days", F.count(F.lit(1)).over(Window.partitionBy(key)))
    n = F.col("days")
    length = F.least(F.lit(sequence), F.greatest(F.lit(least), F.floor((n - lead_time - horizon - 4) / 2)))
    usable = n - lead_time - length + 1 - (horizon - 1)
    enough = (n >= least + lead_time + horizon + LEAST_DAYS - 2) & (usable >= LEAST_DAYS)
    train = F.greatest(F.lit(2), F.least(usable - 2, F.bround(usable * F.lit(Decimal(str(share)))))).cast("bigint")
    at = {"train_from": length, "train_to": length + train - 1, "valid_from": length + train - 1 + horizon, "valid_to": n - lead_time}
    picked = [F.min(F.when(enough & (F.col("_i") == i), F.col(t))).alias(c) for c, i in at.items()]
    numbers = {"sequence": F.when(enough, length), "shortened": F.when(enough, length < sequence), "train_days": F.when(enough, train), "validation_days": F.when(enough, at["valid_to"] - at["valid_from"] + 1)}
    return own.groupBy(key, "days").agg(*[F.first(c).alias(name) for name, c in numbers.items()], *picked)


def timestep_counters(leads: Column, length: int, overlap: int) -> Column:
    """Counter inputs of a sample: 0 on hindcast days, the least lead on the overlap's, then the leads."""
    least = F.array_min(leads)
    return F.concat(F.array_repeat(F.lit(0), length - overlap), F.array_repeat(least, overlap), F.array_sort(leads))


def plan_window(last_valid: Column, state: Column, issue: Column, lookback: int | None = None, cold_lookback: int = 365) -> tuple[Column, Column, Column]:
    """(mode, begin, end) of a run that ends at the issue date.

    It begins at the earlier of the last valid day and the state's date, whichever there are, so that the catch-up covers both: `hot`
    with a state, `resumed` without one. With neither it is `cold` and begins cold_lookback days back. A given lookback moves the
    begin back at least so far, and replaces cold_lookback. It never begins after the issue date.
    """
    first = F.least(state, last_valid)  # of those that are there
    mode = F.when(state.isNotNull(), "hot").when(last_valid.isNotNull(), "resumed").otherwise("cold")
    back = F.date_sub(issue, cold_lookback if lookback is None else lookback)
    begin = F.when(first.isNull(), back).otherwise(F.least(first, issue) if lookback is None else F.least(first, issue, back))
    return mode, begin, issue


def reduce_samples(df: DataFrame, keys: list[str], value: str, how: str = "mean") -> DataFrame:
    """One value for the samples of each key: their mean or median."""
    return df.groupBy(*keys).agg((F.avg(value) if how == "mean" else F.percentile(value, F.lit(0.5))).alias(value))


def extend_stats(scaler: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    """scaler (feature, mean, std) with the features that it lacks; a scale that is zero or not a number is an error."""
    sums = df.agg(*[x for c in features for x in (F.avg(c).alias(f"m{c}"), F.stddev_pop(c).alias(f"s{c}"))])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{c}").cast("double").alias("mean"), F.col(f"s{c}").cast("double").alias("std")) for c in features])
    found = sums.select(F.inline(each)).join(scaler.select("feature"), "feature", "left_anti")
    std = F.when((F.col("std") > 0) & ~F.isnan("std"), F.col("std")).otherwise(F.raise_error(F.lit("a feature has no spread")).cast("double"))
    return scaler.select("feature", "mean", "std").unionByName(found.withColumn("std", std))
