"""Forecast payloads of providers as flat records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.frequency import ev1_line, gumbel_k

#: Periods that every reach is to have.
CANONICAL = [2.0, 5.0, 20.0, 100.0]


def forecast_records(df: DataFrame, key: str, payload: str, now: str | None = None, stale_hours: int = 24) -> DataFrame:
    """(key, issue, time, stat, value) from {"issue": ..., "forecasts": [{"time": ..., "median" or "mean": ...}]}.

    Records with neither statistic are left out; only each key's newest issue with a finite point stays. With `now`, an issue that is
    older than stale_hours then is no forecast any more.
    """
    schema = "issue STRING, forecasts ARRAY<STRUCT<time: STRING, median: DOUBLE, mean: DOUBLE>>"
    rows = df.select(key, F.from_json(payload, schema).alias("p")).select(key, F.col("p.issue").try_cast("timestamp").alias("issue"), F.explode("p.forecasts").alias("f"))
    stat = F.when(F.col("f.median").isNotNull(), "median").when(F.col("f.mean").isNotNull(), "mean")
    flat = rows.select(key, "issue", F.col("f.time").try_cast("timestamp").alias("time"), stat.alias("stat"), F.coalesce("f.median", "f.mean").alias("value")).where("stat IS NOT NULL AND time IS NOT NULL")
    flat = flat.where(~F.isnan("value") & (F.abs("value") < float("inf")))
    if now is not None:
        flat = flat.where(F.col("issue") >= F.to_timestamp(F.lit(now)) - F.make_interval(hours=F.lit(stale_hours)))
    return flat.withColumn("_n", F.max("issue").over(Window.partitionBy(key))).where("issue = _n").drop("_n")


def return_period_levels(df: DataFrame, key: str, payload: str, least: int = 3) -> DataFrame:
    """(key, period, flow) from a JSON object of return_period_<T>: positive finite flows, three at least, the canonical ones filled by a line in Gumbel's factor."""
    pairs = df.select(key, F.explode(F.from_json(payload, "MAP<STRING, DOUBLE>")).alias("name", "flow"))
    known = pairs.select(key, F.regexp_extract("name", r"^return_period_(\d+(?:\.\d+)?)$", 1).alias("t"), "flow").where("t <> '' AND flow > 0").select(key, F.col("t").cast("double").alias("period"), "flow").where("period > 1")
    enough = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)
    known = known.join(enough, key, "left_semi")
    line = ev1_line(known, key)
    wanted = line.withColumn("period", F.explode(F.array(*[F.lit(t) for t in CANONICAL]))).join(known.select(key, "period"), [key, "period"], "left_anti")
    filled = wanted.select(key, "period", (F.col("intercept") + F.col("slope") * gumbel_k(F.col("period"))).alias("flow"))
    return known.unionByName(filled)


#: Periods that a payload may name, and the objects inside one that may hold them beside the reach's own.
KNOWN = [2.0, 5.0, 10.0, 20.0, 25.0, 50.0, 100.0]
HOLDERS = ["return_periods", "returnperiods", "gumbel", "data"]


def return_period_payloads(df: DataFrame, key: str, payload: str, least: int = 3) -> DataFrame:
    """(key, period, flow) from any of a payload's shapes, the canonical periods filled as in return_period_levels.

    Names are return_period_<T> or <T>, at the top or in an object of HOLDERS or of the reach's id, the first of a period counting; or
    the lists `return_period` and `gumbel` (else `logpearson3`) side by side. A value is a number, a list's first, or an
    object's for the reach, else its first. Reaches with fewer than `least` periods have no rows.
    """
    text = "MAP<STRING, STRING>"
    own = df.select(F.col(key).alias("_key"), F.col(key).cast("string").alias("_id"), F.from_json(payload, text).alias("_p"))
    inner = F.transform(F.array(F.col("_id"), *[F.lit(h) for h in HOLDERS]), lambda k: F.from_json(F.try_element_at("_p", k), text))
    maps = F.filter(F.concat(F.array("_p"), inner), lambda m: m.isNotNull())
    lists = lambda c: F.from_json(F.try_element_at("_p", F.lit(c)), "ARRAY<STRING>")
    pairs = F.arrays_zip(lists("return_period").alias("key"), F.coalesce(lists("gumbel"), lists("logpearson3")).alias("value"))
    named = F.filter(F.flatten(F.transform(maps, lambda m: F.map_entries(m))), lambda e: e["key"].startswith("return_period_") | e["key"].rlike(r"^\s*\d+\s*$"))
    told = own.select("_key", "_id", F.posexplode(F.concat(named, F.coalesce(F.when(F.size(named) == 0, F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))), F.array().cast("array<struct<key:string,value:string>>")))).alias("_n", "_e"))
    v = F.col("_e.value")
    of_map = F.from_json(v, text)
    value = F.coalesce(F.get(F.from_json(v, "ARRAY<STRING>"), F.lit(0)), F.try_element_at(of_map, F.col("_id")), F.get(F.map_values(of_map), F.lit(0)), v).try_cast("double")
    period = F.regexp_replace(F.lower(F.trim("_e.key")), "return_period_", "").try_cast("double")
    flat = told.select("_key", "_n", period.alias("period"), value.alias("flow")).where(F.col("period").isin(KNOWN) & (F.abs("flow") < float("inf")))
    known = flat.groupBy("_key", "period").agg(F.min_by("flow", "_n").alias("flow")).select(F.col("_key").alias(key), "period", F.round("flow", 2).alias("flow"))
    enough = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)
    known = known.join(enough, key, "left_semi")
    wanted = ev1_line(known, key).withColumn("period", F.explode(F.array(*[F.lit(t) for t in CANONICAL]))).join(known.select(key, "period"), [key, "period"], "left_anti")
    return known.unionByName(wanted.select(key, "period", (F.col("intercept") + F.col("slope") * gumbel_k(F.col("period"))).alias("flow")))
