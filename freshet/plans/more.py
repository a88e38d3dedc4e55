"""Further queries: parity scores, losses, trends, provider payloads, places."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.operators import climate, frame, frequency, models, network, samples, skill, zonal
from freshet.plans import base
from freshet.plans.base import query
from freshet.sources import providers

R = lambda c, n=6: F.round(c, n)


@query("rank_correlation", """WITH v AS (SELECT basin, obs, sim FROM obs_sim WHERE obs IS NOT NULL AND sim IS NOT NULL),
r AS (SELECT basin, rank() OVER (PARTITION BY basin ORDER BY obs) + (count(*) OVER (PARTITION BY basin, obs) - 1) / 2.0 AS x, rank() OVER (PARTITION BY basin ORDER BY sim) + (count(*) OVER (PARTITION BY basin, sim) - 1) / 2.0 AS y FROM v)
SELECT basin, round(corr(x, y), 6) AS spearman, count(*) AS n FROM r GROUP BY 1""", "obs_sim")
def rank_correlation(spark, d):
    return skill.rank_correlation(base.obs_sim(spark, d), ["basin"], "obs", "sim").withColumn("spearman", R("spearman"))


@query("penalised_scores", """WITH s AS (SELECT basin, round(1 - avg((sim - obs)^2) / var_pop(obs), 6) AS nse FROM obs_sim WHERE sim IS NOT NULL GROUP BY 1)
SELECT basin, coalesce(nse, -1e9) AS nse FROM (SELECT DISTINCT basin FROM obs_sim) LEFT JOIN s USING (basin)""", "obs_sim")
def penalised_scores(spark, d):
    f = base.obs_sim(spark, d)
    return skill.penalised(skill.skill(f, ["basin"], ["nse"]).withColumn("nse", R("nse")), f, "basin", "nse", -1e9)


@query("masked_losses", """WITH s AS (SELECT basin, stddev_pop(q) AS std FROM flow GROUP BY 1)
SELECT basin, lead, round(avg((sim - obs)^2) / 2, 4) AS mse_loss, round(sqrt(avg((sim - obs)^2)) / sqrt(2), 6) AS rmse_loss, round(avg((sim - obs)^2 / (std + 0.1)^2), 6) AS nse_loss
FROM forecast JOIN s USING (basin) WHERE sim IS NOT NULL GROUP BY 1, 2""", "flow forecast")
def masked_losses(spark, d):
    spread = base.flow(spark, d).groupBy("basin").agg(F.stddev_pop("q").alias("std"))
    out = skill.masked_losses(base.forecast(spark, d), ["basin", "lead"], spread, "basin")
    return out.select("basin", "lead", R("mse_loss", 4).alias("mse_loss"), R("rmse_loss").alias("rmse_loss"), R("nse_loss").alias("nse_loss"))


@query("severity_trend", """WITH n AS (SELECT basin, q, row_number() OVER (PARTITION BY basin ORDER BY date) AS i, count(*) OVER (PARTITION BY basin) AS n FROM flow WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-06-30'),
m AS (SELECT basin, max(q) AS peak, avg(q) FILTER (i <= greatest(1, n // 3)) AS h, avg(q) FILTER (i > n - greatest(1, n // 3)) AS t FROM n GROUP BY 1)
SELECT basin, peak, CASE WHEN t > h * 1.05 THEN 'rising' WHEN t < h * 0.95 THEN 'falling' ELSE 'steady' END AS trend FROM m""", "flow")
def severity_trend(spark, d):
    f = frame.filter_period(base.flow(spark, d), "date", [("1998-03-01", "1998-06-30")])
    return frame.severity_trend(f, "basin", "date", "q")


@query("rebinned_rates", """WITH s AS (SELECT basin, date, (lead - 1) * 4 AS a, lead * 4 AS b, obs AS r FROM forecast), k AS (SELECT *, unnest(range(a // 6, ceil(b / 6)::BIGINT)) AS k FROM s)
SELECT basin, date, k * 6 AS a, round(sum((least(b, (k + 1) * 6) - greatest(a, k * 6)) * r) / 6, 6) AS r FROM k GROUP BY basin, date, k HAVING sum(least(b, (k + 1) * 6) - greatest(a, k * 6)) = 6""", "forecast")
def rebinned_rates(spark, d):
    s = base.forecast(spark, d).select("basin", "date", ((F.col("lead") - 1) * 4).cast("bigint").alias("a"), (F.col("lead") * 4).cast("bigint").alias("b"), F.col("obs").alias("r"))
    return frame.rebin_rates(s, ["basin", "date"], "a", "b", "r", 6).withColumn("r", R("r"))


@query("provider_forecasts", """WITH p AS (SELECT user_id AS reach, '2024-01-0' || (1 + event_id % 3) || ' 00:00:00' AS issue, '2024-02-' || lpad((1 + event_id % 28)::VARCHAR, 2, '0') || ' 00:00:00' AS t, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS v, event_id % 2 = 0 AS med FROM events)
SELECT reach, issue, t AS time, CASE WHEN med THEN 'median' ELSE 'mean' END AS stat, v AS value FROM p WHERE v IS NOT NULL QUALIFY issue = max(issue) OVER (PARTITION BY reach)""")
def provider_forecasts(spark, d):
    e, k = base.read(spark, d, "events"), F.col("event_id")
    v = F.when(k % 5 != 0, F.col("value"))
    record = F.struct(F.concat(F.lit("2024-02-"), F.lpad((1 + k % 28).cast("string"), 2, "0")).alias("time"), F.when(k % 2 == 0, v).alias("median"), F.when(k % 2 == 1, v).alias("mean"))
    payload = F.to_json(F.struct(F.concat(F.lit("2024-01-0"), (1 + k % 3).cast("string")).alias("issue"), F.array(record).alias("forecasts")))
    out = providers.forecast_records(e.select(F.col("user_id").alias("reach"), payload.alias("p")), "reach", "p")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("reach", stamp("issue"), stamp("time"), "stat", "value")


_K = lambda t: f"(-sqrt(6) / pi() * ({frequency.EULER} + ln(ln({t} / ({t} - 1)))))"


@query("return_period_levels", f"""WITH k AS (SELECT s_suppkey, t, flow FROM (SELECT s_suppkey, unnest([2.0, 10.0, 50.0])::DOUBLE AS t, unnest([100.0, 200.0, 300.0])::DOUBLE + s_suppkey AS flow FROM supplier)),
l AS (SELECT s_suppkey, regr_slope(flow, {_K('t')}) AS s, regr_intercept(flow, {_K('t')}) AS i FROM k GROUP BY 1)
SELECT s_suppkey, t AS period, flow FROM k UNION ALL SELECT s_suppkey, t, round(i + s * {_K('t')}, 6) FROM l, (SELECT unnest([5.0, 20.0, 100.0])::DOUBLE AS t)""")
def return_period_levels(spark, d):
    k = F.col("s_suppkey")
    payload = F.to_json(F.struct(*[(F.lit(float(v)) + k).alias(f"return_period_{t}") for t, v in ((2, 100), (10, 200), (50, 300))], F.lit(-1.0).alias("return_period_25"), F.lit(3.0).alias("other")))
    out = providers.return_period_levels(base.read(spark, d, "supplier").select(k, payload.alias("p")), "s_suppkey", "p")
    return out.withColumn("flow", R("flow"))


@query("locate_units", """SELECT p.point_id, u.point_id AS unit_id FROM points p, points u WHERE abs(p.lat - u.lat) + least(abs(p.lon - u.lon), 360 - abs(p.lon - u.lon)) < 7.05""", "points")
def locate_units(spark, d):
    """Points in diamonds of 7.05 degrees around all points, past the antimeridian too; coordinates have one decimal, so none lies on an edge."""
    p = base.points(spark, d)
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    ring = F.array(corner(-7.05, 0.0), corner(0.0, -7.05), corner(7.05, 0.0), corner(0.0, 7.05))
    units = p.select(F.col("point_id").alias("unit_id"), ring.alias("ring"))
    return network.locate_units(p, units)


@query("zonal_climatology", """WITH x AS (SELECT lat_idx, lon_idx, week, CASE WHEN (lat_idx + lon_idx * 3) % 13 > 0 THEN value END AS p, value * 1.1 AS pet, month(week) - 5.0 AS temp FROM grid WHERE year(week) BETWEEN 1996 AND 1999),
t AS (SELECT basin, sum(weight) AS w FROM weights GROUP BY 1), s AS (SELECT basin, week, sum(weight) FILTER (p IS NOT NULL) AS a, sum(weight * p) AS b, sum(weight) AS c, sum(weight * pet) AS d FROM x JOIN weights USING (lat_idx, lon_idx) GROUP BY 1, 2),
v AS (SELECT basin, CASE WHEN a / w >= 0.8 THEN b / a END AS p, CASE WHEN c / w >= 0.8 THEN d / c END AS pet FROM s JOIN t USING (basin))
SELECT basin, round(avg(p), 4) AS p_mean, round(avg(pet), 4) AS pet_mean, round(avg(pet) / avg(p), 4) AS aridity FROM v GROUP BY 1""", "grid weights")
def zonal_climatology(spark, d):
    g = base.grid(spark, d)
    x = g.select("lat_idx", "lon_idx", "week", F.when((F.col("lat_idx") + F.col("lon_idx") * 3) % 13 > 0, F.col("value")).alias("a"), (F.col("value") * 1.1).alias("b"), (F.month("week") - 5.0).alias("c"))
    out = climate.zonal_climatology(x, base.weights(spark, d), {"p": "a", "pet": "b", "temp": "c"}, "week", "1996", "1999")
    return out.select("basin", "p_mean", "pet_mean", "aridity")


@query("daily_from_steps", """WITH s AS (SELECT basin, date, lead * 9 AS step, obs::DOUBLE AS state, sum(obs) OVER (PARTITION BY basin, date ORDER BY lead)::DOUBLE AS total FROM forecast),
d AS (SELECT basin, date, ((step - 1) // 24 + 1)::INT AS lead_day, avg(state) AS state, max_by(total, step) AS a FROM s GROUP BY 1, 2, 3)
SELECT basin, date, lead_day, round(state, 6) AS state, a - coalesce(lag(a) OVER (PARTITION BY basin, date ORDER BY lead_day), 0) AS total FROM d""", "forecast")
def daily_from_steps(spark, d):
    f = base.forecast(spark, d).select("basin", "date", (F.col("lead") * 9).alias("step"), F.col("obs").cast("double").alias("state"))
    running = F.sum("state").over(Window.partitionBy("basin", "date").orderBy("step"))
    return zonal.daily_from_steps(f.withColumn("total", running), ["basin", "date"], "step", "state", "total").withColumn("state", R("state"))


@query("combined_missing", """WITH f AS (SELECT basin, date, obs, sim, CASE WHEN day(date) % 3 > 0 THEN day(date) / 31.0 END AS a, day(date) % 4 / 4.0 AS b FROM obs_sim)
SELECT basin, date, round(CASE WHEN sim IS NULL THEN 1 ELSE greatest(coalesce(a, 1), coalesce(b, 1)) END, 6) AS missing FROM f""", "obs_sim")
def combined_missing(spark, d):
    day = F.day("date")
    f = base.obs_sim(spark, d).withColumns({"a": F.when(day % 3 > 0, day / 31.0), "b": day % 4 / 4.0})
    return f.select("basin", "date", R(zonal.combine_missing(f, "sim", ["a", "b"])).alias("missing"))


@query("sample_counters", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '0,0,0,1,1,1,2,3' ELSE '0,0,0,2,2,2,4' END AS counters FROM supplier""")
def sample_counters(spark, d):
    leads = F.when(F.col("s_suppkey") % 2 == 0, F.array(*[F.lit(k) for k in (3, 1, 2)])).otherwise(F.array(*[F.lit(k) for k in (4, 2)]))
    text = F.array_join(F.transform(samples.timestep_counters(leads, 5, 2), lambda v: v.cast("string")), ",")
    return base.read(spark, d, "supplier").select("s_suppkey", text.alias("counters"))


@query("nudged_forecasts", """WITH b AS (SELECT basin, date, sim AS flow, sim * 0.8 AS low FROM obs_sim), o AS (SELECT basin, date, obs::DOUBLE AS obs FROM obs_sim WHERE day(date) % 4 > 0 AND basin % 7 > 0),
j AS (SELECT * FROM b JOIN o USING (basin, date) WHERE flow IS NOT NULL), a AS (SELECT basin, coalesce(max(date) FILTER (date <= DATE '2001-06-15'), max(date)) AS anchor FROM j GROUP BY 1),
r AS (SELECT basin, anchor, avg(obs - flow) AS residual FROM j JOIN a USING (basin) WHERE date <= anchor AND date > anchor - 10 GROUP BY 1, 2),
d AS (SELECT b.*, anchor, residual, CASE WHEN date >= anchor THEN date - anchor END AS step FROM b LEFT JOIN r USING (basin))
SELECT basin, date, step, round(0.8 * 0.9 ^ step * residual, 6) AS delta, round(CASE WHEN step IS NOT NULL AND flow IS NOT NULL THEN greatest(0, flow + 0.8 * 0.9 ^ step * residual) ELSE flow END, 6) AS flow,
round(CASE WHEN step IS NOT NULL AND flow IS NOT NULL THEN greatest(0, low + 0.8 * 0.9 ^ step * residual) ELSE low END, 6) AS low FROM d""", "obs_sim")
def nudged_forecasts(spark, d):
    f = base.obs_sim(spark, d)
    own = f.select("basin", "date", F.col("sim").alias("flow"), (F.col("sim") * 0.8).alias("low"))
    seen = f.where((F.day("date") % 4 > 0) & (F.col("basin") % 7 > 0)).select("basin", "date", F.col("obs").cast("double"))
    out = models.nudged(own, seen, "basin", "date", "flow", "obs", 0.9, 0.8, 10, "2001-06-15", ["low"])
    return out.select("basin", "date", "step", R("delta").alias("delta"), R("flow").alias("flow"), R("low").alias("low"))
