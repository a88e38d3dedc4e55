"""Several forecast models of one place: aligned axes, peaks, runs, summaries, differences between forcings and grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.skill import skill


def timeline_align(series: dict[str, DataFrame], key: str, t: str, value: str) -> DataFrame:
    """All timestamps of all models with a column for each model's values; names are fixed by the caller, so no pass finds them."""
    long = None
    for name, df in series.items():
        own = df.where(F.col(value).isNotNull()).select(key, t, F.lit(name).alias("_m"), F.col(value).alias("_v"))
        long = own if long is None else long.unionByName(own)
    return long.groupBy(key, t).agg(*[F.max(F.when(F.col("_m") == name, F.col("_v"))).alias(name) for name in series])


def cadence(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """The median gap in days of each series and its label."""
    gap = F.datediff(t, F.lag(t).over(Window.partitionBy(*keys).orderBy(t)))
    out = df.select(*keys, gap.alias("_g")).groupBy(*keys).agg(F.percentile("_g", F.lit(0.5)).alias("gap_days"))
    return out.withColumn("cadence", F.when(F.col("gap_days") <= 1, "daily").when(F.col("gap_days") <= 7, "weekly").otherwise("sparse"))


def model_peaks(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Peak and its earliest date of each model's daily series, and the mean."""
    first = F.struct(F.col(value), F.datediff(F.lit("1900-01-01"), F.col(t)))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(value).alias("peak"), F.max_by(t, first).alias("peak_date"), F.avg(value).alias("mean"))


#: Risk levels from the lowest.
RISKS = ["UNKNOWN", "NORMAL", "WARNING", "SEVERE", "EXTREME"]


def flood_summary(consensus: DataFrame, key: str, model: str) -> DataFrame:
    """What the independent models that are live say together, a row for each key.

    Rows (key, model, available, independent, status, rank, label, risk); those count that are available, independent and
    `live` or `severity_only`. (models_over, models, governing, max_rank, label, risk, agreement): how many of them reach the 2-year flow
    (rank 1), the model of the highest rank (the first by name of a tie), and the highest known risk.
    """
    counts = F.col("available") & F.col("independent") & F.col("status").isin("live", "severity_only")
    rank = F.coalesce("rank", F.lit(0))
    own = F.when(F.coalesce(counts, F.lit(False)), F.lit(True))
    level = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("risk"))
    first = F.min(F.when(own, F.struct((-rank).alias("r"), F.col(model).alias("m"), F.col("label").alias("l"))))
    out = consensus.groupBy(key).agg(F.count_if(own & (rank >= 1)).alias("models_over"), F.count(own).alias("models"), first.alias("_f"), F.max(F.when(own & (level > 0), level)).alias("_k"))
    text = F.format_string("%d of %d independent models forecast \u2265 2-yr exceedance", "models_over", "models")
    risk = F.coalesce(F.get(F.array(*[F.lit(r) for r in RISKS]), (F.col("_k") - 1).cast("int")), F.lit("UNKNOWN"))
    return out.select(key, "models_over", "models", F.col("_f.m").alias("governing"), (-F.col("_f.r")).alias("max_rank"), F.coalesce("_f.l", F.lit("Unknown")).alias("label"), risk.alias("risk"), text.alias("agreement"))


def latest_run(df: DataFrame, key: str, issue: str, lead: str, leads: int) -> DataFrame:
    """Rows of each key's newest issue that has `leads` leads at least."""
    full = df.groupBy(key, issue).agg(F.count_distinct(lead).alias("_n")).where(F.col("_n") >= leads).groupBy(key).agg(F.max(issue).alias(issue))
    return df.join(full, [key, issue], "left_semi")


def lead_step(df: DataFrame, keys: list[str], lead: str, wanted: list[int], exact: bool) -> DataFrame:
    """The plane for each wanted lead: that lead (states), or else the first at or after it (rates).

    A rate holds for the interval that ends at its lead, so the rate at lead 0 is that of the first interval. Negative leads and
    leads beyond the run have no plane.
    """
    target = F.when(F.col("wanted") > 0, F.col("wanted").cast("double")).otherwise(1e-6)
    near = df.withColumn("wanted", F.explode(F.array(*[F.lit(w) for w in wanted]))).where("wanted >= 0").where(F.col(lead) == F.col("wanted") if exact else F.col(lead) >= target)
    rest = [c for c in df.columns if c not in keys and c != lead]
    out = near.groupBy(*keys, "wanted").agg(F.min_by(F.struct(lead, *rest), lead).alias("_b"))
    return out.select(*keys, "wanted", f"_b.{lead}", *[f"_b.{c}" for c in rest])


def to_discharge(scaled: Column, mean: Column, std: Column, area_km2: Column) -> Column:
    """A scaled prediction in mm a day as m3/s, 0 at least."""
    return F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), scaled * std + mean) * area_km2 / 86.4)


def peak_step(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """The peak of each forecast and its step, the latest of a tie."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(value).alias("peak"), F.max_by(step, F.struct(value, step)).alias("peak_step"))


def union_stores(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of both stores; of a key in both, the first store's value unless that is missing."""
    both = first.select(*keys, value, F.lit(0).alias("_s")).unionByName(second.select(*keys, value, F.lit(1).alias("_s")))
    return both.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_s"))).alias(value), F.count(F.lit(1)).alias("stores"))


def fresh_status(reaches: DataFrame, status: DataFrame, key: str, t: str, cutoff: str) -> DataFrame:
    """Reaches with their newest status if it is newer than the cut-off; queued if there is none."""
    newest = status.where(F.col(t) > F.to_timestamp(F.lit(cutoff))).groupBy(key).agg(F.max_by("status", F.struct(t, "status")).alias("status"), F.max(t).alias(t))
    return reaches.join(newest, key, "left").withColumn("queued", F.col(t).isNull())


def queue(df: DataFrame, area: str, key: str, n: int) -> DataFrame:
    """The n largest of the queued reaches: a top-n report."""
    return df.where("queued").orderBy(F.col(area).desc(), key).limit(n)


def expected_scores(scores: DataFrame, keys: list[str], period: str, values: list[str], weights: dict[float, float]) -> DataFrame:
    """Scores over return periods under fixed weights: the sum over periods that have the score, and `_norm` divided by their weights."""
    w = F.coalesce(*[F.when(F.col(period) == p, F.lit(v)) for p, v in weights.items()], F.lit(0.0))
    sums = [x for v in values for x in (F.sum(F.when(F.col(v).isNotNull(), w * F.col(v))).alias(f"{v}_sum"), F.sum(F.when(F.col(v).isNotNull(), w)).alias(f"{v}_w"))]
    have = scores.groupBy(*keys).agg(*sums)
    return have.select(*keys, *[c for v in values for c in (F.when(F.col(f"{v}_w") > 0, F.col(f"{v}_sum")).alias(v), F.try_divide(F.col(f"{v}_sum"), F.when(F.col(f"{v}_w") > 0, F.col(f"{v}_w"))).alias(f"{v}_norm"))])


def forcing_delta(a: DataFrame, b: DataFrame, keys: list[str], t: str, obs: str, sim: str) -> DataFrame:
    """Predictions of one model under two forcings: metrics of each on its own valid days, their differences, and how far apart the predictions are.

    missing_a and missing_b count days with an observation but no prediction; with any of them the status is NAN_PRED. A series
    without spread has no correlation unless both are the same everywhere, when it is 1. Keys of either side have a row.
    """
    both = a.select(*keys, t, F.col(obs).alias("_oa"), F.col(sim).alias("_a")).join(b.select(*keys, t, F.col(obs).alias("_ob"), F.col(sim).alias("_b")), [*keys, t], "full_outer")
    names = ["nse", "kge", "rmse", "alpha_nse", "beta_nse"]
    one = {side: skill(both.select(*keys, F.col(f"_o{side}").alias("obs"), F.col(f"_{side}").alias("sim")), keys, names).withColumnsRenamed({n: f"{n}_{side}" for n in names}) for side in "ab"}
    pair = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    x, y = F.when(pair, F.col("_a")), F.when(pair, F.col("_b"))
    off = y - x
    gone = lambda side: F.count_if(F.col(f"_o{side}").isNotNull() & F.col(f"_{side}").isNull())
    apart = both.groupBy(*keys).agg(
        gone("a").alias("missing_a"), gone("b").alias("missing_b"), F.count(off).alias("_n"), F.max(F.abs(off)).alias("_max"), F.avg(F.abs(off)).alias("_mean"), F.sqrt(F.avg(off**2)).alias("_rmse"),
        F.try_divide(F.covar_pop(x, y), F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.stddev_pop(x) * F.stddev_pop(y))).alias("_r"),
    )
    two = lambda c: F.when(F.col("_n") >= 2, c)
    out = apart.join(one["a"], keys, "left").join(one["b"], keys, "left")
    status = F.when((F.col("missing_a") == 0) & (F.col("missing_b") == 0), "OK").otherwise("NAN_PRED")
    deltas = [(F.col(f"{n}_b") - F.col(f"{n}_a")).alias(f"delta_{n}") for n in ("nse", "kge", "rmse")]
    return out.select(
        *keys, status.alias("status"), "missing_a", "missing_b", two(F.col("_max")).alias("max_apart"), two(F.col("_mean")).alias("mean_apart"), two(F.col("_rmse")).alias("rmse_apart"),
        two(F.coalesce("_r", F.when(F.col("_max") == 0, 1.0))).alias("r_apart"), *[f"{n}_{side}" for side in "ab" for n in names], *deltas,
    )


def delta_profile(deltas: DataFrame, lead: str) -> DataFrame:
    """forcing_delta's rows by lead: basins, those without a score, and the spread of scores and of the sizes of their differences."""
    size = F.abs("delta_nse")
    spread = lambda c, name: [F.min(c).alias(f"min_{name}"), F.percentile(c, F.lit(0.1)).alias(f"p10_{name}"), F.percentile(c, F.lit(0.5)).alias(f"median_{name}")]
    return deltas.groupBy(lead).agg(
        F.count(F.lit(1)).alias("basins"), F.count_if(F.col("nse_a").isNull() | F.col("nse_b").isNull()).alias("without_score"), F.sum("missing_a").alias("missing_a"), F.sum("missing_b").alias("missing_b"),
        *spread("nse_a", "nse_a"), *spread("nse_b", "nse_b"), F.percentile(size, F.lit(0.5)).alias("median_delta"), F.percentile(size, F.lit(0.95)).alias("p95_delta"), F.max(size).alias("max_delta"),
    )


def compare_grids(rebuilt: DataFrame, reference: DataFrame, cells: list[str], by: list[str], value: str) -> DataFrame:
    """How a rebuilt grid agrees with its reference, a row for each of `by`: where values are missing, and how far valid ones differ.

    A cell that one side doesn't have is missing there. Errors are of cells valid on both sides: mae, rmse, bias, quantiles and the
    largest of the absolute error, the shares within 1e-5 and exactly equal, means and deviations, and r where
    both sides vary; NULL where no cell is valid on both.
    """
    both = rebuilt.select(*by, *cells, F.col(value).cast("double").alias("_x")).join(reference.select(*by, *cells, F.col(value).cast("double").alias("_y")), [*by, *cells], "full_outer")
    valid = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    x, y = F.when(valid, F.col("_x")), F.when(valid, F.col("_y"))
    off = x - y
    size = F.abs(off)
    varies = (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
    n = F.count(F.lit(1))
    count = {"both_valid": F.count_if(valid), "both_missing": F.count_if(F.col("_x").isNull() & F.col("_y").isNull()), "rebuilt_missing": F.count_if(F.col("_x").isNull() & F.col("_y").isNotNull()), "reference_missing": F.count_if(F.col("_x").isNotNull() & F.col("_y").isNull())}
    return both.groupBy(*by).agg(
        n.alias("cells"), *[c.alias(name) for name, c in count.items()], *[(100.0 * c / n).alias(f"{name}_percent") for name, c in count.items()],
        F.avg(size).alias("mae"), F.sqrt(F.avg(off**2)).alias("rmse"), F.avg(off).alias("bias"), *[F.percentile(size, F.lit(q / 100)).alias(f"p{q}") for q in (50, 75, 90, 95, 99)], F.max(size).alias("max"),
        F.avg((size <= 1e-5).cast("int")).alias("near_equal"), F.avg((size == 0).cast("int")).alias("equal"), F.avg(x).alias("rebuilt_mean"), F.avg(y).alias("reference_mean"),
        F.stddev_pop(x).alias("rebuilt_std"), F.stddev_pop(y).alias("reference_std"), F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias("r"),
    )


def window_forecast(df: DataFrame, keys: list[str], hours: Column, value: str) -> DataFrame:
    """Means and sums of a forecast by whole days of lead."""
    return df.groupBy(*keys, F.ceil(hours / 24).alias("day")).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"))


def nudged(base: DataFrame, observed: DataFrame, key: str, t: str, flow: str, obs: str, rho: float, alpha: float, window: int, issue: str | None = None, bands: list[str] = ()) -> DataFrame:
    """base with flow and its bands corrected by the persistence of its last residuals; adds anchor, residual, step and delta.

    The anchor is the last day, up to the issue date where there is one, with a flow and an observation that isn't negative; the
    residual is the mean of obs - flow over the `window` days that end there. Days from the anchor on get alpha x rho^step of it, and nothing falls
    below 0. Keys without such a day stay as they are. rho and alpha are clipped to 0..1.
    """
    rho, alpha, window = min(max(rho, 0.0), 1.0), min(max(alpha, 0.0), 1.0), max(window, 1)
    seen = observed.where(F.col(obs) >= 0).select(key, t, F.col(obs).alias("_obs"))
    both = base.where(F.col(flow).isNotNull()).select(key, t, F.col(flow).alias("_flow")).join(seen, [key, t])
    before = F.max(F.when(F.lit(True) if issue is None else F.col(t) <= F.to_date(F.lit(issue)), F.col(t)))
    anchors = both.groupBy(key).agg(F.coalesce(before, F.max(t)).alias("anchor"))
    near = both.join(anchors, key).where((F.col(t) <= F.col("anchor")) & (F.col(t) > F.date_sub("anchor", window)))
    residual = near.groupBy(key, "anchor").agg(F.avg(F.col("_obs") - F.col("_flow")).alias("residual"))
    step = F.when(F.col(t) >= F.col("anchor"), F.datediff(t, "anchor"))
    out = base.join(residual, key, "left").withColumn("step", step).withColumn("delta", alpha * F.pow(F.lit(rho), F.col("step")) * F.col("residual"))
    moved = lambda c: F.when(F.col("delta").isNotNull() & F.col(c).isNotNull() & F.col(flow).isNotNull(), F.greatest(F.lit(0.0), F.col(c) + F.col("delta"))).otherwise(F.col(c))
    new = {c: moved(c) for c in (*bands, flow)}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns], "anchor", "residual", "step", "delta")


def half_life(rho: float) -> float | None:
    """Days in which a residual that persists by rho a day is halved; None where it never is, or at once."""
    return -math.log(2) / math.log(rho) if 0 < rho < 1 else None
