"""Training samples of daily series with forecasts: masks, windows and filled features by one set of rules, and models that score them.

A series is one row for each key and day without gaps (densify first); forecast features are arrays over leads, issued on that day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.frame import sequence_valid


@dataclass(frozen=True)
class SampleRules:
    """What makes a sample. Lengths are in days; leads are those of the forecast arrays, rising, the first being the shortest.

    groups are feature groups of the handling `nan_handling` (none, input_replacing, masked_mean, attention, unioning); without them all
    features of a side are one group. min_lead is 1 if samples have forecasts and 0 if they don't.
    """

    hindcast: list[str] = field(default_factory=list)
    forecast: list[str] = field(default_factory=list)
    target: list[str] = field(default_factory=list)
    static: list[str] = field(default_factory=list)
    leads: list[int] = field(default_factory=list)
    length: int = 365
    lead_time: int = 0
    min_lead: int = 0
    overlap: int = 0
    predict_last: int = 1
    nan_handling: str = "none"
    hindcast_groups: list[list[str]] = field(default_factory=list)
    forecast_groups: list[list[str]] = field(default_factory=list)
    refuse_zero_targets: bool = False

    def __post_init__(self) -> None:
        if not (self.hindcast or self.forecast or self.target or self.static):
            raise ValueError("a sample needs features")
        for groups, names, side in ((self.hindcast_groups, self.hindcast, "hindcast"), (self.forecast_groups, self.forecast, "forecast")):
            if any(not set(g) <= set(names) for g in groups):
                raise ValueError(f"a {side} group has other features")
        if self.nan_handling not in ("none", "input_replacing", "masked_mean", "attention", "unioning"):
            raise ValueError(f"no such handling: {self.nan_handling}")
        if self.forecast and not self.leads:
            raise ValueError("forecasts need leads")


def lead_arrays(forecast: DataFrame, key: str, t: str, lead: str, features: list[str], leads: list[int]) -> DataFrame:
    """Long forecasts (key, t, lead, features) as one row for each issue day with an array over `leads` for each feature."""
    at = lambda f: F.array(*[F.max(F.when(F.col(lead) == k, F.col(f))) for k in leads])
    return forecast.groupBy(key, t).agg(*[at(f).alias(f) for f in features])


def _all(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, xs)


def _any(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, xs)


def _usable(names: list[str], groups: list[list[str]], how: str, whole: Callable[[str], Column], some: Callable[[str], Column]) -> Column:
    groups = groups or [names]
    if how == "none":
        return _all([whole(c) for c in names])
    if how == "input_replacing":
        return _any([some(c) for c in names])
    if how == "unioning":
        return _all([_any([some(c) for c in g]) for g in groups])
    return _any([_all([whole(c) for c in g]) for g in groups])


def sample_masks(df: DataFrame, key: str, t: str, rules: SampleRules, dates: DataFrame | None = None, training: bool = True) -> DataFrame:
    """(key, t, a mask for each rule, valid): which days can issue a sample.

    statics: all there; hindcasts: usable on all `length` days that end min_lead days before; forecasts: usable, a
    feature being whole with all its leads and there with any; forecast_overlap: the first lead usable on `overlap` days that end min_lead
    days before; non_zero_targets and targets (training only): not all zero that day (missing counts as not zero), and any target there on one
    of the predict_last days that end lead_time - min_lead days after; dates: in the given days. Windows that reach beyond the series aren't valid.
    """
    r, have = rules, lambda c: F.col(c).isNotNull()
    lead_whole = lambda c: have(c) & F.forall(F.coalesce(F.col(c), F.array()), lambda x: x.isNotNull())
    lead_some = lambda c: have(c) & F.exists(F.coalesce(F.col(c), F.array()), lambda x: x.isNotNull())
    first = lambda c: F.get(c, F.lit(0)).isNotNull()
    true = F.lit(True)
    masks = {"statics": _all([have(c) for c in r.static]) if r.static else true}
    every = lambda m, n, shift: sequence_valid(F.coalesce(m, F.lit(False)), key, t, n, shift) if n > 0 else true
    masks["hindcasts"] = every(_usable(r.hindcast, r.hindcast_groups, r.nan_handling, have, have), r.length, -r.min_lead) if r.hindcast else true
    masks["forecasts"] = _usable(r.forecast, r.forecast_groups, r.nan_handling, lead_whole, lead_some) if r.forecast else true
    masks["forecast_overlap"] = every(_usable(r.forecast, r.forecast_groups, r.nan_handling, first, first), r.overlap, -r.min_lead) if r.forecast and r.overlap else true
    masks["non_zero_targets"] = _any([F.coalesce(F.col(c) != 0, true) for c in r.target]) if r.target and training and r.refuse_zero_targets else true
    masks["targets"] = sequence_valid(_any([have(c) for c in r.target]), key, t, r.predict_last, r.lead_time - r.min_lead, every=False) if r.target and training else true
    out = df.withColumns({f"_{name}": m for name, m in masks.items()})
    if dates is not None:
        out = out.join(F.broadcast(dates.select(F.col(t)).distinct().withColumn("_dates", true)), t, "left")  # a row for each day of a calendar
        masks["dates"] = F.col("_dates")
    kept = [F.coalesce(F.col(f"_{name}"), F.lit(False)).alias(name) for name in masks]
    out = out.select(key, t, *kept)
    return out.withColumn("valid", _all([F.col(name) for name in masks]))


def _span(column: Column, key: str, t: str, begin: int, end: int) -> Column:
    """Values of rows begin to end as an array; missing ones are kept."""
    w = Window.partitionBy(key).orderBy(t).rowsBetween(begin, end)
    return F.transform(F.collect_list(F.struct(column.alias("v"))).over(w), lambda x: x["v"])


def build_samples(df: DataFrame, key: str, t: str, rules: SampleRules) -> DataFrame:
    """(key, t, x_<feature>, f_<feature>, y_<feature>, statics) of every day; the days that sample_masks finds valid have whole windows.

    x: the `length` days that end min_lead days before the issue day (a forecast feature gives its first lead there); f: the
    leads of the issue day, before them the first leads of the `overlap` days that x ends with; y: `length` days that end lead_time -
    min_lead days after. Windows that reach beyond the series are shorter. A key's series is one window partition.
    """
    r = rules
    leads = set(r.forecast)
    x = {f"x_{c}": _span(F.get(c, F.lit(0)) if c in leads else F.col(c), key, t, 1 - r.min_lead - r.length, -r.min_lead) for c in r.hindcast}
    f = {f"f_{c}": F.concat(_span(F.get(c, F.lit(0)), key, t, 1 - r.min_lead - r.overlap, -r.min_lead), F.col(c)) if r.overlap else F.col(c) for c in r.forecast}
    end = r.lead_time - r.min_lead if r.leads else 0
    y = {f"y_{c}": _span(F.col(c), key, t, end - r.length + 1, end) for c in r.target}
    return df.select(key, t, *[c.alias(n) for n, c in {**x, **f, **y}.items()], *r.static)


def union_features(df: DataFrame, key: str, t: str, fills: dict[str, str], leads: list[int], lead_features: list[str]) -> DataFrame:
    """df with missing values of each feature taken from another, by valid day: lead k issued on D is valid on D + k - 1.

    Both with leads or both without: the same place. With leads from without: each lead takes the value of its valid day.
    Without from with: the shortest lead of the forecast that is valid that day. All fills read the values as they were.
    """
    if lacking := [b for a, b in fills.items() if a in df.columns and b not in df.columns]:
        raise ValueError(f"the rows lack {lacking}")
    w = Window.partitionBy(key).orderBy(t)
    shortest = leads.index(min(leads)) if leads else 0
    new = {}
    for a, b in fills.items():
        if a == b or a not in df.columns:
            continue
        if a in lead_features and b not in lead_features:
            new[a] = F.array(*[F.coalesce(F.get(a, F.lit(i)), F.lead(b, k - 1).over(w) if k >= 1 else F.lag(b, 1 - k).over(w)) for i, k in enumerate(leads)])
        elif b in lead_features and a not in lead_features:
            new[a] = F.coalesce(F.col(a), F.lag(F.get(b, F.lit(shortest)), min(leads) - 1).over(w))
        elif a in lead_features:
            new[a] = F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull(), F.col(a)).otherwise(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)))
        else:
            new[a] = F.coalesce(a, b)
    return df.withColumns(new)


def score_samples(samples: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keep: list[str], batch: int = 512) -> DataFrame:
    """Samples scored by a user's model, a function from a frame of samples to one of as many rows with the columns of `schema`.

    The model sees `batch` rows at most at a time, as many as a forward pass takes; the columns in `keep` stay. Its
    weights travel with the function, or it loads them once in each worker.
    """
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for i in range(0, len(rows), batch):
                own = rows.iloc[i : i + batch].reset_index(drop=True)
                out = model(own)
                if len(out) != len(own):
                    raise ValueError("the model gave another number of rows")
                yield pd.concat([own[keep], out[names].reset_index(drop=True)], axis=1)

    return samples.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), schema]))
