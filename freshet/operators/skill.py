"""Forecast skill, flow-duration biases and parity of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r of pairs; NULL where a side has no spread (the built-in corr is an error there under ANSI rules)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def metric_columns(obs: str = "obs", sim: str = "sim") -> dict[str, Column]:
    """Aggregates over rows where both sides are valid; use them with `both_valid`."""
    o, s = F.col(obs), F.col(sim)
    mse = F.avg((s - o) ** 2)
    so, ss = F.stddev_pop(o), F.stddev_pop(s)
    r, n = correlation(o, s), F.count(F.lit(1))
    beta = F.try_divide(F.avg(s), F.avg(o))
    kge = 1 - F.sqrt((r - 1) ** 2 + (F.try_divide(ss, so) - 1) ** 2 + (beta - 1) ** 2)
    return {
        "n": n,
        "nse": 1 - F.try_divide(mse, F.var_pop(o)),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "alpha_nse": F.try_divide(ss, so),
        "beta_nse": F.try_divide(F.avg(s) - F.avg(o), so),
        "beta_kge": beta,
        "kge": F.when(n >= 2, kge),
        "pearson_r": F.when(n >= 2, r),
    }


def both_valid(df: DataFrame, obs: str = "obs", sim: str = "sim") -> DataFrame:
    return df.where(F.col(obs).isNotNull() & F.col(sim).isNotNull())


#: Users' metrics by name: (column builder or None, function of two series or None); see registries.
EXTRA: dict[str, tuple] = {}


def _aggregated(df: DataFrame, by: list[str], names: list[str], obs: str, sim: str) -> DataFrame:
    """Column metrics in one aggregation, and functions of series in another, joined."""
    known = metric_columns(obs, sim) | {k: build(obs, sim) for k, (build, _) in EXTRA.items() if build}
    if lacking := [n for n in names if n not in known and n not in EXTRA]:
        raise ValueError(f"no such metrics: {lacking}")
    out = df.groupBy(*by).agg(*[known[k].alias(k) for k in names if k in known] or [F.count(F.lit(1)).alias("_n")])
    own = [k for k in names if k not in known]
    if own:
        udf = lambda f: F.pandas_udf(f, "double", F.PandasUDFType.GROUPED_AGG)(F.col(obs).cast("double"), F.col(sim).cast("double"))
        more = df.groupBy(*by).agg(*[udf(EXTRA[k][1]).alias(k) for k in own]).withColumnsRenamed({c: f"_{c}" for c in by})
        match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        out = out.join(more, match, "left") if by else out.crossJoin(more)
    return out.select(*by, *names)


def skill(df: DataFrame, by: list[str], names: list[str] | None = None, obs: str = "obs", sim: str = "sim") -> DataFrame:
    """The named metrics of each group, registered ones too, in one aggregation if all are columns."""
    return _aggregated(both_valid(df, obs, sim), by, names or list(metric_columns(obs, sim)), obs, sim)


def skill_by_lead(df: DataFrame, key: str, lead: str, names: list[str], obs: str = "obs", sim: str = "sim") -> DataFrame:
    """Metrics of each key and lead, and pooled over leads (lead NULL), from one pass with grouping sets; functions of series take two."""
    valid = both_valid(df, obs, sim)
    if any(EXTRA.get(n, (True,))[0] is None for n in names):
        pooled = _aggregated(valid, [key], names, obs, sim).withColumn(lead, F.lit(None).cast(df.schema[lead].dataType))
        return _aggregated(valid, [key, lead], names, obs, sim).unionByName(pooled)
    known = metric_columns(obs, sim) | {k: build(obs, sim) for k, (build, _) in EXTRA.items() if build}
    return valid.groupingSets([[F.col(key), F.col(lead)], [F.col(key)]], F.col(key), F.col(lead)).agg(*[known[k].alias(k) for k in names])


def medians(table: DataFrame, names: list[str]) -> DataFrame:
    """Median over entities of each metric, long."""
    return table.unpivot([], [F.col(n) for n in names], "metric", "v").groupBy("metric").agg(F.percentile("v", F.lit(0.5)).alias("median"), F.count("v").alias("entities"))


def duration_bias(df: DataFrame, key: str, obs: str = "obs", sim: str = "sim", high: float = 0.02, low: float = 0.3, lower: float = 0.2, upper: float = 0.7) -> DataFrame:
    """Biases of the flow-duration curve in percent: top flows (fhv), low flows (flv) and mid slope (fms).

    Each side is sorted by itself; the ranks are those of rounding half to even. In logarithms values below 1e-6 count as 1e-6.
    """
    eps = 1e-6
    valid = both_valid(df, obs, sim)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rank = lambda c: F.row_number().over(Window.partitionBy(key).orderBy(F.col(c).desc()))
    ranked = valid.select(key, F.col(obs).alias("o"), F.col(sim).alias("s"), n.alias("n"), rank(obs).alias("ro"), rank(sim).alias("rs"))
    top, bottom = F.bround(high * F.col("n")), F.bround((1 - low) * F.col("n"))
    at = lambda r, share: F.col(r) == F.greatest(F.lit(1), F.bround(share * F.col("n")))
    ln = lambda c: F.log(F.greatest(F.col(c), F.lit(eps)))
    out = ranked.groupBy(key).agg(
        F.sum(F.when(F.col("rs") <= top, F.col("s"))).alias("s_top"), F.sum(F.when(F.col("ro") <= top, F.col("o"))).alias("o_top"),
        F.sum(F.when(F.col("rs") > bottom, ln("s"))).alias("s_low"), F.sum(F.when(F.col("ro") > bottom, ln("o"))).alias("o_low"),
        F.min(F.when(F.col("rs") > bottom, ln("s"))).alias("s_min"), F.min(F.when(F.col("ro") > bottom, ln("o"))).alias("o_min"),
        F.sum(F.when(F.col("rs") > bottom, 1).otherwise(0)).alias("k"),
        *[F.max(F.when(at(r, x), ln(c))).alias(f"{c}_{tag}") for r, c in (("ro", "o"), ("rs", "s")) for tag, x in (("a", lower), ("b", upper))],
    )
    s_part, o_part = F.col("s_low") - F.col("k") * F.col("s_min"), F.col("o_low") - F.col("k") * F.col("o_min")
    slope_o, slope_s = F.col("o_a") - F.col("o_b"), F.col("s_a") - F.col("s_b")
    return out.select(
        key, (F.try_divide(F.col("s_top") - F.col("o_top"), F.col("o_top")) * 100).alias("fhv"), (-100 * (s_part - o_part) / (o_part + eps)).alias("flv"), ((slope_s - slope_o) / (slope_o + eps) * 100).alias("fms"),
    )


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str, by: list[str] = ()) -> DataFrame:
    """Parity of two tables: counts of valid and missing pairs, bias, errors, ratio of variances, r, close shares."""
    joined = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full")
    x, y = F.col("x"), F.col("y")
    both = x.isNotNull() & y.isNotNull()
    d = F.when(both, x - y)
    count = lambda c: F.count_if(c)
    aggregates = [
        count(both).alias("both_valid"), count(x.isNotNull() & y.isNull()).alias("only_a"), count(x.isNull() & y.isNotNull()).alias("only_b"),
        F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), correlation(F.when(both, x), F.when(both, y)).alias("r"),
        F.try_divide(F.var_pop(F.when(both, x)), F.var_pop(F.when(both, y))).alias("variance_ratio"), F.avg(F.when(both, (F.abs(d) <= 1e-3).cast("double"))).alias("within_1e3"),
    ]
    return joined.groupBy(*by).agg(*aggregates)


def quantile_coverage(df: DataFrame, by: list[str], obs: str, sample: str, keys: list[str], bands=(0.9, 0.8, 0.5, 0.2, 0.1)) -> DataFrame:
    """Share of observations inside central bands of their samples."""
    shares = [x for b in bands for x in ((1 - b) / 2, (1 + b) / 2)]
    q = df.groupBy(*keys).agg(F.first(obs).alias("o"), F.percentile(sample, F.array(*[F.lit(s) for s in shares])).alias("q"))
    return q.groupBy(*by).agg(*[F.avg(F.col("o").between(F.col("q")[2 * i], F.col("q")[2 * i + 1]).cast("double")).alias(f"within_{int(b * 100)}") for i, b in enumerate(bands)])


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman's coefficient: Pearson's r of ranks, ties with their mean rank."""
    valid = both_valid(df, x, y)

    def mean_rank(c: str) -> Column:
        first = F.rank().over(Window.partitionBy(*by).orderBy(c))
        return first + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0

    ranked = valid.select(*by, mean_rank(x).alias("_x"), mean_rank(y).alias("_y"))
    return ranked.groupBy(*by).agg(correlation(F.col("_x"), F.col("_y")).alias("spearman"), F.count(F.lit(1)).alias("n"))


def penalised(table: DataFrame, cohort: DataFrame, key: str, column: str, penalty: float) -> DataFrame:
    """A score for every member of the cohort: the penalty where there is none."""
    return cohort.select(key).distinct().join(table.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(penalty)))


def masked_losses(df: DataFrame, by: list[str], spread: DataFrame, key: str, obs: str = "obs", sim: str = "sim") -> DataFrame:
    """Half mean squared error, root over sqrt 2, and squared error weighted by 1 / (sigma + 0.1)^2 of the basin, over valid rows."""
    d = F.col(sim) - F.col(obs)
    valid = both_valid(df, obs, sim).join(spread.select(key, "std"), key)
    return valid.groupBy(*by).agg(
        (F.avg(d * d) / 2).alias("mse_loss"), (F.sqrt(F.avg(d * d)) / F.sqrt(F.lit(2.0))).alias("rmse_loss"), F.avg(d * d / (F.col("std") + 0.1) ** 2).alias("nse_loss")
    )
