"""Mixtures of asymmetric Laplace distributions as columns: array<struct<mu, b, tau, pi>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Newton steps, what keeps a density from zero, and the share of the components' quantiles that bounds a step.
STEPS, FLOOR, CONFINE = 10, 1e-6, 0.8


def _sum(c: Column, f) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + f(x))


def mixture_mean(c: Column) -> Column:
    def one(x):
        tau = F.least(F.greatest(x["tau"], F.lit(1e-6)), F.lit(1 - 1e-6))
        return x["pi"] * (x["mu"] + x["b"] * (1 - 2 * tau) / (tau * (1 - tau)))

    return _sum(c, one)


def component_quantile(x: Column, q: float) -> Column:
    low = x["mu"] + x["b"] / (1 - x["tau"]) * F.log(F.lit(q) / x["tau"])
    return F.when(F.lit(q) <= x["tau"], low).otherwise(x["mu"] - x["b"] / x["tau"] * F.log(F.lit(1 - q) / (1 - x["tau"])))


def mixture_cdf(c: Column, at: Column) -> Column:
    def one(x):
        z = (at - x["mu"]) / x["b"]
        return x["pi"] * F.when(at > x["mu"], 1 - (1 - x["tau"]) * F.exp(-x["tau"] * z)).otherwise(x["tau"] * F.exp(z * (1 - x["tau"])))

    return _sum(c, one)


def mixture_pdf(c: Column, at: Column) -> Column:
    def one(x):
        z = (at - x["mu"]) / x["b"]
        return x["pi"] * x["tau"] * (1 - x["tau"]) / x["b"] * F.exp(F.when(at > x["mu"], -x["tau"] * z).otherwise((1 - x["tau"]) * z))

    return _sum(c, one)


def mixture_quantile(c: Column, q: float) -> Column:
    """Newton's method on the distribution from the mean of the components' quantiles, inside 0.8 times their range."""
    own = F.transform(c, lambda x: component_quantile(x, q))
    low, high = CONFINE * F.array_min(own), CONFINE * F.array_max(own)
    start = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), start, lambda k, _: F.least(F.greatest(k - (mixture_cdf(c, k) - q) / (mixture_pdf(c, k) + FLOOR), low), high)
    )


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 that the parts alone decide: 52 bits of the MD5 of their texts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def _component_at(x: Column, u: Column) -> Column:
    """The value of an asymmetric Laplace distribution at u."""
    tau = F.least(F.greatest(x["tau"], F.lit(1e-6)), F.lit(1 - 1e-6))
    low = x["mu"] + x["b"] * F.log(u / tau) / (1 - tau)
    return F.when(u < tau, low).otherwise(x["mu"] - x["b"] * F.log((1 - u) / (1 - tau)) / tau)


def mixture_sample(c: Column, row: Column, draw: Column, seed: str = "0", negatives: str = "none", zero: float = 0.0, retries: int = 5) -> Column:
    """Draw number `draw` of a row's mixture: the component by the inverse of the weights, then its value.

    Random numbers depend on seed, row, draw and try alone, so draws are the same on any partitioning and after lost
    executors. negatives: `none` leaves values below `zero`, `clip` raises them to it, `truncate` draws the value anew from the same
    component, `retries` times at most, after which it stays below. A mixture without weight gives NULL.
    """
    if negatives not in ("none", "clip", "truncate"):
        raise ValueError(f"no such way with negatives: {negatives}")
    total = _sum(c, lambda x: x["pi"])
    u = uniform(F.lit(seed), F.lit("c"), row, draw) * total

    def step(acc, x):
        upto = acc["upto"] + x["pi"]
        here = acc["found"].isNull() & (x["pi"] > 0) & (u < upto)
        return F.struct(upto.alias("upto"), F.when(here, x).otherwise(acc["found"]).alias("found"))

    kind = F.struct(F.lit(0.0).alias("upto"), F.when(F.lit(False), F.element_at(c, 1)).alias("found"))
    found = F.aggregate(c, kind, step, lambda acc: F.coalesce(acc["found"], F.element_at(F.filter(c, lambda x: x["pi"] > 0), -1)))

    def value(n: Column) -> Column:
        return _component_at(found, uniform(F.lit(seed), F.lit("v"), row, draw, n))

    if negatives == "truncate":
        tries = F.sequence(F.lit(1), F.lit(retries)) if retries else F.array().cast("array<int>")
        out = F.aggregate(tries, value(F.lit(0)), lambda acc, n: F.when(acc < zero, value(n)).otherwise(acc))
    else:
        out = value(F.lit(0))
        out = F.greatest(out, F.lit(float(zero))) if negatives == "clip" else out
    return F.when(total > 0, out)
