"""Queries on samples, several models, and places, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.operators import frame, frequency, models, samples, snapping
from freshet.plans import base
from freshet.plans.base import VIEWS, query

R = lambda c, n=6: F.round(c, n)

VIEWS |= {
    "daily": """SELECT basin, d.date, q FROM (SELECT basin, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date
        FROM flow GROUP BY 1) d LEFT JOIN flow f USING (basin, date)""",
    "streams": """SELECT s_suppkey AS reach_id, (s_suppkey * 53 % 1400) / 10.0::DOUBLE - 70 AS lat1, (s_suppkey * 97 % 3400) / 10.0::DOUBLE - 170 AS lon1,
        (s_suppkey * 53 % 1400) / 10.0::DOUBLE - 69.8 AS lat2, (s_suppkey * 97 % 3400) / 10.0::DOUBLE - 169.7 AS lon2, s_acctbal + 1000 AS area FROM supplier""",
    "gauges": """SELECT c_custkey AS point_id, (c_custkey * 37 % 1400) / 10.0::DOUBLE - 70 AS lat, (c_custkey * 61 % 3400) / 10.0::DOUBLE - 170 AS lon, c_acctbal + 1001 AS target_area FROM customer""",
    "features": """SELECT basin, date, obs, sim, CASE WHEN day(date) % 7 = 0 THEN NULL ELSE obs END AS alt FROM obs_sim""",
}
_KM = """sqrt(power((lon - lon1) * cos(radians(lat)) - f * 0.3 * cos(radians(lat)), 2) + power((lat - lat1) - f * (lat2 - lat1), 2)) * 111.195"""
_F = """least(1.0, greatest(0.0, ((lon - lon1) * cos(radians(lat)) * (lon2 - lon1) * cos(radians(lat)) + (lat - lat1) * (lat2 - lat1)) / (power((lon2 - lon1) * cos(radians(lat)), 2) + power(lat2 - lat1, 2))))"""


def streams(spark, d):
    k = F.col("s_suppkey")
    lat, lon = k * 53 % 1400 / 10.0, k * 97 % 3400 / 10.0
    return base.read(spark, d, "supplier").select(k.alias("reach_id"), (lat - 70).alias("lat1"), (lon - 170).alias("lon1"), (lat - 69.8).alias("lat2"), (lon - 169.7).alias("lon2"), (F.col("s_acctbal") + 1000).alias("area"))


def gauges(spark, d):
    k = F.col("c_custkey")
    return base.read(spark, d, "customer").select(k.alias("point_id"), (k * 37 % 1400 / 10.0 - 70).alias("lat"), (k * 61 % 3400 / 10.0 - 170).alias("lon"), (F.col("c_acctbal") + 1001).alias("target_area"))


def daily(spark, d):
    return frame.densify_daily(base.flow(spark, d), "basin", "date").select("basin", "date", "q")


@query("group_masks", """SELECT basin, date, obs IS NOT NULL AND sim IS NOT NULL AND alt IS NOT NULL AS every_feature, obs IS NOT NULL OR sim IS NOT NULL OR alt IS NOT NULL AS any_feature,
 (obs IS NOT NULL AND sim IS NOT NULL) OR alt IS NOT NULL AS any_group, (obs IS NOT NULL OR sim IS NOT NULL) AND alt IS NOT NULL AS each_group FROM features""", "obs_sim features")
def group_masks(spark, d):
    f = base.obs_sim(spark, d).withColumn("alt", F.when(F.day("date") % 7 != 0, F.col("obs")))
    groups = [["obs", "sim"], ["alt"]]
    how = {"every_feature": "none", "any_feature": "input_replacing", "any_group": "masked_mean", "each_group": "unioning"}
    return f.select("basin", "date", *[samples.group_mask(groups, m).alias(c) for c, m in how.items()])


@query("valid_samples", """WITH w AS (SELECT basin, date, count(q) OVER h AS h, count(*) OVER h AS hn, count(q) OVER t AS t, count(*) OVER t AS tn FROM daily
 WINDOW h AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), t AS (PARTITION BY basin ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT basin, date FROM w JOIN (SELECT s_nationkey AS basin, max(s_acctbal) AS top FROM supplier GROUP BY 1) USING (basin)
WHERE hn = 10 AND h = 10 AND tn = 3 AND t > 0 AND top > 0 AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""", "flow daily")
def valid_samples(spark, d):
    statics = base.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("basin")).agg(F.max("s_acctbal").alias("top"))
    f, have = daily(spark, d).join(statics, "basin"), F.col("q").isNotNull()
    return samples.valid_samples(f, "basin", "date", have, have, 10, 3, F.col("top") > 0, "1996-01-01", "2000-12-31")


def _text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("bigint").cast("string")), ",", "NA").alias(c)


@query("sample_windows", """WITH t AS (SELECT basin, date, coalesce(CAST(q AS BIGINT)::VARCHAR, 'NA') AS v FROM daily),
w AS (SELECT basin, date, list(v) OVER (PARTITION BY basin ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x, list(v) OVER (PARTITION BY basin ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS y FROM t)
SELECT basin, date, array_to_string(x, ',') AS x, array_to_string(y, ',') AS y FROM w WHERE len(x) = 5 AND len(y) = 3""", "flow daily")
def sample_windows(spark, d):
    """Windows on a daily index; missing days are kept (NA in the text)."""
    out = samples.sample_windows(daily(spark, d), "basin", "date", "q", 5, 3)
    return out.select("basin", "date", _text("x"), _text("y"))


@query("union_by_valid_date", """SELECT f.basin, f.lead, f.date, coalesce(f.sim, q.q) AS sim FROM forecast f LEFT JOIN flow q ON q.basin = f.basin AND q.date = f.date + (f.lead - 1)::INTEGER""", "flow forecast")
def union_by_valid_date(spark, d):
    f = base.forecast(spark, d).select("basin", "lead", "date", "sim")
    return samples.union_by_valid_date(f, base.flow(spark, d), "basin", "date", "lead", "sim", "q")


@query("partition_dates", """WITH i AS (SELECT basin, date, row_number() OVER (PARTITION BY basin ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY basin) AS n FROM flow),
l AS (SELECT *, least(600, greatest(8, floor((n - 5 - 7 - 4) / 2)))::BIGINT AS s FROM i), u AS (SELECT *, n - 5 - s + 1 - 6 AS usable FROM l),
c AS (SELECT *, n >= 8 + 5 + 7 + 2 AND usable >= 4 AS ok, greatest(2, least(usable - 2, round_even(usable * 0.7, 0)))::BIGINT AS train FROM u)
SELECT basin, n AS days, any_value(CASE WHEN ok THEN s END) AS sequence, any_value(CASE WHEN ok THEN s < 600 END) AS shortened, any_value(CASE WHEN ok THEN train END) AS train_days, any_value(CASE WHEN ok THEN n - 5 - (s + train - 1 + 7) + 1 END) AS validation_days,
min(date) FILTER (ok AND i = s) AS train_from, min(date) FILTER (ok AND i = s + train - 1) AS train_to, min(date) FILTER (ok AND i = s + train - 1 + 7) AS valid_from, min(date) FILTER (ok AND i = n - 5) AS valid_to FROM c GROUP BY basin, n""", "flow")
def partition_dates(spark, d):
    return samples.partition_dates(base.flow(spark, d), "basin", "date", 0.7, 5, 600, 7)


@query("run_windows", """WITH l AS (SELECT basin, CASE WHEN basin % 4 > 0 THEN max(date) END AS last, CASE WHEN basin % 3 > 0 THEN max(date) - (basin % 5)::INTEGER END AS state FROM flow GROUP BY 1)
SELECT basin, CASE WHEN state IS NOT NULL THEN 'hot' WHEN last IS NOT NULL THEN 'resumed' ELSE 'cold' END AS mode, CASE WHEN state IS NULL AND last IS NULL THEN DATE '2001-07-31' - 365 ELSE least(state, last, DATE '2001-07-31') END AS begin,
DATE '2001-07-31' AS end_, least(state, last, DATE '2001-07-31' - 30) AS early FROM l""", "flow")
def run_windows(spark, d):
    last = base.flow(spark, d).groupBy("basin").agg(F.max("date").alias("top"))
    known, state = F.when(F.col("basin") % 4 > 0, F.col("top")), F.when(F.col("basin") % 3 > 0, F.date_sub("top", (F.col("basin") % 5).cast("int")))
    issue = F.to_date(F.lit("2001-07-31"))
    mode, begin, end = samples.plan_window(known, state, issue)
    return last.select("basin", mode.alias("mode"), begin.alias("begin"), end.alias("end_"), samples.plan_window(known, state, issue, 30)[1].alias("early"))


@query("reduced_samples", """SELECT basin, date, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM ensemble GROUP BY 1, 2""", "ensemble")
def reduced_samples(spark, d):
    e = base.ensemble(spark, d)
    mean, median = (samples.reduce_samples(e, ["basin", "date"], "value", how).withColumnRenamed("value", how) for how in ("mean", "median"))
    return mean.join(median, ["basin", "date"]).select("basin", "date", R("mean").alias("mean"), R("median").alias("median"))


@query("extended_stats", """SELECT 'l_quantity' AS feature, 1.0::DOUBLE AS mean, 2.0::DOUBLE AS std
UNION ALL SELECT 'l_discount', round(avg(l_discount), 6), round(stddev_pop(l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) FROM lineitem""")
def extended_stats(spark, d):
    scaler = spark.createDataFrame([("l_quantity", 1.0, 2.0)], "feature string, mean double, std double")
    out = samples.extend_stats(scaler, base.read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.select("feature", R("mean").alias("mean"), R("std").alias("std"))


@query("aligned_models", """WITH a AS (SELECT basin, date, obs FROM obs_sim WHERE obs IS NOT NULL), b AS (SELECT basin, date, sim FROM obs_sim WHERE sim IS NOT NULL), c AS (SELECT basin, date, max(value) AS ens FROM ensemble GROUP BY 1, 2)
SELECT basin, date, obs, sim, ens FROM a FULL JOIN b USING (basin, date) FULL JOIN c USING (basin, date)""", "obs_sim ensemble")
def aligned_models(spark, d):
    f = base.obs_sim(spark, d)
    ens = base.ensemble(spark, d).groupBy("basin", "date").agg(F.max("value").alias("v"))
    series = {"obs": f.withColumn("v", F.col("obs").cast("double")), "sim": f.withColumn("v", F.col("sim")), "ens": ens}
    return models.timeline_align(series, "basin", "date", "v").withColumn("obs", F.col("obs").cast(f.schema["obs"].dataType))


@query("cadences", """WITH g AS (SELECT basin, date - lag(date) OVER (PARTITION BY basin ORDER BY date) AS g FROM (SELECT DISTINCT basin, date FROM ensemble))
SELECT basin, median(g)::DOUBLE AS gap_days, CASE WHEN median(g) <= 1 THEN 'daily' WHEN median(g) <= 7 THEN 'weekly' ELSE 'sparse' END AS cadence FROM g GROUP BY 1""", "ensemble")
def cadences(spark, d):
    return models.cadence(base.ensemble(spark, d).select("basin", "date").distinct(), ["basin"], "date")


@query("model_peaks", """SELECT basin, member, max(value) AS peak, arg_max(date, (value, -(date - DATE '1900-01-01'))) AS peak_date, round(avg(value), 6) AS mean FROM ensemble WHERE value IS NOT NULL GROUP BY 1, 2""", "ensemble")
def model_peaks(spark, d):
    return models.model_peaks(base.ensemble(spark, d), ["basin", "member"], "date", "value").withColumn("mean", R("mean"))


@query("flood_summary", """WITH t AS (SELECT basin, member, max(value) AS v FROM ensemble GROUP BY 1, 2),
c AS (SELECT basin, member, basin % 6 > 0 AS available, member <> '2-HIGH' AS independent, CASE WHEN basin % 5 = 0 AND member = '1-URGENT' THEN 'stale' WHEN basin % 2 = 0 THEN 'live' ELSE 'severity_only' END AS status,
CASE WHEN v >= 450000 THEN 2 WHEN v >= 400000 THEN 1 WHEN v >= 100000 THEN 0 END AS rank, CASE WHEN v >= 450000 THEN 'SEVERE' WHEN v >= 400000 THEN 'WARNING' WHEN v >= 300000 THEN 'NORMAL' ELSE 'other' END AS risk FROM t),
k AS (SELECT *, available AND independent AND status IN ('live', 'severity_only') AS own, coalesce(rank, 0) AS r, list_position(['UNKNOWN', 'NORMAL', 'WARNING', 'SEVERE', 'EXTREME'], risk) AS level FROM c),
g AS (SELECT basin, count(*) FILTER (own AND r >= 1) AS models_over, count(*) FILTER (own) AS models, max(r) FILTER (own) AS max_rank, max(level) FILTER (own) AS level FROM k GROUP BY 1)
SELECT g.basin, models_over, models, (SELECT min(member) FROM k WHERE k.basin = g.basin AND own AND r = max_rank) AS governing, max_rank, CASE WHEN max_rank IS NULL THEN 'Unknown' ELSE 'rank ' || max_rank END AS label,
coalesce((['UNKNOWN', 'NORMAL', 'WARNING', 'SEVERE', 'EXTREME'])[level], 'UNKNOWN') AS risk, models_over || ' of ' || models || ' independent models forecast ≥ 2-yr exceedance' AS agreement FROM g""", "ensemble")
def flood_summary(spark, d):
    v, m, b = F.col("v"), F.col("member"), F.col("basin")
    top = base.ensemble(spark, d).groupBy("basin", "member").agg(F.max("value").alias("v"))
    rank = F.when(v >= 450000, 2).when(v >= 400000, 1).when(v >= 100000, 0)
    risk = F.when(v >= 450000, "SEVERE").when(v >= 400000, "WARNING").when(v >= 300000, "NORMAL").otherwise("other")
    status = F.when((b % 5 == 0) & (m == "1-URGENT"), "stale").when(b % 2 == 0, "live").otherwise("severity_only")
    rows = top.select("basin", "member", (b % 6 > 0).alias("available"), (m != "2-HIGH").alias("independent"), status.alias("status"), rank.alias("rank"), F.concat(F.lit("rank "), F.coalesce(rank, F.lit(0))).alias("label"), risk.alias("risk"))
    return models.flood_summary(rows, "basin", "member")


@query("latest_run", """WITH c AS (SELECT basin, date FROM forecast GROUP BY 1, 2 HAVING count(DISTINCT lead) >= 2), l AS (SELECT basin, max(date) AS date FROM c GROUP BY 1)
SELECT f.basin, f.date, f.lead, f.obs FROM forecast f JOIN l USING (basin, date)""", "forecast")
def latest_run(spark, d):
    return models.latest_run(base.forecast(spark, d), "basin", "date", "lead", 2).select("basin", "date", "lead", "obs")


@query("lead_planes", """WITH planes AS (SELECT basin, date, lead - 1 AS lead, obs FROM forecast), w AS (SELECT unnest([0, 2, 4, 6]) AS wanted), r AS (SELECT basin, date, wanted, min(lead) AS lead, arg_min(obs, lead) AS obs FROM planes, w WHERE lead >= wanted AND lead > 0 GROUP BY 1, 2, 3)
SELECT r.basin, r.date, r.wanted, r.lead, r.obs, e.obs AS state FROM r LEFT JOIN planes e ON e.basin = r.basin AND e.date = r.date AND e.lead = r.wanted""", "forecast")
def lead_planes(spark, d):
    f = base.forecast(spark, d).select("basin", "date", (F.col("lead") - 1).alias("lead"), "obs")
    rates = models.lead_step(f, ["basin", "date"], "lead", [-1, 0, 2, 4, 6], exact=False)
    states = models.lead_step(f, ["basin", "date"], "lead", [-1, 0, 2, 4, 6], exact=True).select("basin", "date", "wanted", F.col("obs").alias("state"))
    return rates.join(states, ["basin", "date", "wanted"], "left")


@query("discharge_peaks", """WITH q AS (SELECT basin, date, lead, round(greatest(0, (sim / 100 - 1) * 3 + 2) * 500 / 86.4, 6) AS q FROM forecast WHERE sim IS NOT NULL)
SELECT basin, date, max(q) AS peak, arg_max(lead, (q, lead)) AS peak_step FROM q GROUP BY 1, 2""", "forecast")
def discharge_peaks(spark, d):
    q = models.to_discharge(F.col("sim") / 100 - 1, F.lit(2.0), F.lit(3.0), F.lit(500.0))
    return models.peak_step(base.forecast(spark, d).withColumn("q", R(q)), ["basin", "date"], "lead", "q")


@query("union_stores", """WITH a AS (SELECT basin, date, q FROM flow WHERE date < DATE '1999-01-01'), b AS (SELECT basin, date, q + 1 AS q FROM flow WHERE date >= DATE '1998-06-01')
SELECT basin, date, coalesce(a.q, b.q) AS q, (a.basin IS NOT NULL)::BIGINT + (b.basin IS NOT NULL)::BIGINT AS stores FROM a FULL JOIN b USING (basin, date)""", "flow")
def union_stores(spark, d):
    f = base.flow(spark, d)
    return models.union_stores(f.where("date < '1999-01-01'"), f.where("date >= '1998-06-01'").withColumn("q", F.col("q") + 1), ["basin", "date"], "q")


@query("fresh_status", """WITH s AS (SELECT user_id AS reach_id, arg_max(event_type, (ts, event_type)) AS status, max(ts) AS t FROM events WHERE ts > TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1)
SELECT reach_id, area, status, t IS NULL AS queued FROM reaches LEFT JOIN s USING (reach_id)""", "reaches")
def fresh_status(spark, d):
    status = base.read(spark, d, "events").select(F.col("user_id").alias("reach_id"), "ts", F.col("event_type").alias("status"))
    return models.fresh_status(base.reaches(spark, d), status, "reach_id", "ts", "2024-01-29 12:00:00").select("reach_id", "area", "status", "queued")


@query("status_queue", """WITH s AS (SELECT DISTINCT user_id AS reach_id FROM events WHERE ts > TIMESTAMP '2024-01-29 12:00:00') SELECT reach_id, area FROM reaches WHERE reach_id NOT IN (SELECT reach_id FROM s WHERE reach_id IS NOT NULL) ORDER BY area DESC, reach_id LIMIT 25""", "reaches")
def status_queue(spark, d):
    status = base.read(spark, d, "events").select(F.col("user_id").alias("reach_id"), "ts", F.col("event_type").alias("status"))
    return models.queue(models.fresh_status(base.reaches(spark, d), status, "reach_id", "ts", "2024-01-29 12:00:00"), "area", "reach_id", 25).select("reach_id", "area")


_PERIODS = {1.01: 1.0, 2.0: 0.5, 5.0: 0.2, 10.0: 0.1, 20.0: 0.05}


_THRESHOLDS = """e AS (SELECT basin, lead, avg(obs) AS mo, stddev_samp(obs) AS so, avg(sim) AS ms, stddev_samp(sim) AS ss FROM forecast GROUP BY 1, 2),
t AS (SELECT basin, lead, p AS period, mo + f * so AS lo, ms + f * ss AS ls FROM e, (SELECT unnest([1.01, 2, 5, 10, 20])::DOUBLE AS p, unnest([0.0, 0.5, 1.0, 1.5, 2.5])::DOUBLE AS f))"""
_MARKS = "PARTITION BY basin, lead, period ORDER BY date"


def _scores(w: int) -> str:
    return f"""m{w} AS (SELECT basin, lead, period, date, coalesce(obs >= lo AND (row_number() OVER w = 1 OR lag(obs) OVER w < lo), false) AS o, coalesce(sim >= ls AND (row_number() OVER w = 1 OR lag(sim) OVER w < ls), false) AS s,
CASE WHEN count(obs) OVER v = count(*) OVER v THEN (max(obs) OVER v >= lo)::INT END AS ho, CASE WHEN count(sim) OVER v > 0 THEN (max(sim) OVER v >= ls)::INT END AS hs
FROM forecast JOIN t USING (basin, lead) WINDOW w AS ({_MARKS}), v AS ({_MARKS} ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING)),
g{w} AS (SELECT basin, lead, period, {w} AS win, avg(ho) FILTER (s) AS p, avg(hs) FILTER (o) AS r FROM m{w} GROUP BY ALL)"""


@query("expected_scores", f"""WITH {_THRESHOLDS}, {_scores(0)}, {_scores(2)},
f AS (SELECT *, CASE WHEN p IS NULL AND r IS NULL THEN NULL WHEN coalesce(p, 0) + coalesce(r, 0) = 0 OR p IS NULL OR r IS NULL THEN 0 ELSE 2 * p * r / (p + r) END AS f1,
CASE period WHEN 1.01 THEN 1 WHEN 2 THEN 0.5 WHEN 5 THEN 0.2 WHEN 10 THEN 0.1 ELSE 0.05 END::DOUBLE AS w FROM (SELECT * FROM g0 UNION ALL SELECT * FROM g2))
SELECT basin, lead, win AS "window", {', '.join(f'round(sum(w * {c}), 6) AS {n}, round(sum(w * {c}) / sum(w) FILTER ({c} IS NOT NULL), 6) AS {n}_norm' for c, n in (('p', 'precision'), ('r', 'recall'), ('f1', 'f1')))} FROM f GROUP BY ALL""", "forecast")
def expected_scores(spark, d):
    """Precision, recall and F1 of crossings by lead and window, over five thresholds of each side."""
    f = base.forecast(spark, d)
    spread = f.groupBy("basin", "lead").agg(F.avg("obs").alias("mo"), F.stddev_samp("obs").alias("so"), F.avg("sim").alias("ms"), F.stddev_samp("sim").alias("ss"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.lit(k).alias("f")) for p, k in zip(_PERIODS, (0.0, 0.5, 1.0, 1.5, 2.5))])).alias("x")
    levels = spread.select("basin", "lead", each, "mo", "so", "ms", "ss").select("basin", "lead", "x.period", (F.col("mo") + F.col("x.f") * F.col("so")).alias("obs_threshold"), (F.col("ms") + F.col("x.f") * F.col("ss")).alias("sim_threshold"))
    scores = frequency.period_scores(f, levels, ["basin", "lead"], "date", "period", [0, 2])
    values = ["precision", "recall", "f1"]
    out = models.expected_scores(scores, ["basin", "lead", "window"], "period", values, _PERIODS)
    return out.select("basin", "lead", "window", *[R(c).alias(c) for v in values for c in (v, f"{v}_norm")])


_DELTA = """b AS (SELECT basin, lead, date, obs, CASE WHEN day(date) % 9 = 0 THEN NULL ELSE sim * 1.1 + 1 END AS sim FROM forecast),
j AS (SELECT a.basin, a.lead, a.obs AS o, a.sim AS x, b.sim AS y FROM forecast a JOIN b USING (basin, lead, date)),
s AS (SELECT basin, lead, count(*) FILTER (x IS NULL) AS missing_a, count(*) FILTER (y IS NULL) AS missing_b, max(abs(y - x)) AS m, sqrt(avg((y - x) ^ 2)) AS q, corr(x, y) AS c, count(y - x) AS n,
1 - avg((x - o) ^ 2) / nullif(var_pop(o) FILTER (x IS NOT NULL), 0) AS na, 1 - avg((y - o) ^ 2) / nullif(var_pop(o) FILTER (y IS NOT NULL), 0) AS nb, sqrt(avg((x - o) ^ 2)) AS ra, sqrt(avg((y - o) ^ 2)) AS rb FROM j GROUP BY 1, 2)"""


@query("forcing_delta", f"""WITH {_DELTA} SELECT basin, lead, CASE WHEN missing_a + missing_b = 0 THEN 'OK' ELSE 'NAN_PRED' END AS status, missing_a, missing_b, round(CASE WHEN n >= 2 THEN m END, 6) AS max_apart, round(CASE WHEN n >= 2 THEN q END, 6) AS rmse_apart,
round(CASE WHEN n >= 2 AND NOT isnan(c) THEN c END, 6) AS r_apart, round(na, 5) AS nse_a, round(nb, 5) AS nse_b, round(nb - na, 5) AS delta_nse, round(rb - ra, 5) AS delta_rmse FROM s""", "forecast")
def forcing_delta(spark, d):
    out = _deltas(spark, d)
    return out.select("basin", "lead", "status", "missing_a", "missing_b", *[R(c).alias(c) for c in ("max_apart", "rmse_apart", "r_apart")], *[R(c, 5).alias(c) for c in ("nse_a", "nse_b", "delta_nse", "delta_rmse")])


def _deltas(spark, d):
    f = base.forecast(spark, d)
    other = f.withColumn("sim", F.when(F.day("date") % 9 != 0, F.col("sim") * 1.1 + 1))
    return models.forcing_delta(f, other, ["basin", "lead"], "date", "obs", "sim")


@query("delta_profile", f"""WITH {_DELTA} SELECT lead, count(*) AS basins, count(*) FILTER (na IS NULL OR nb IS NULL) AS without_score, sum(missing_a)::BIGINT AS missing_a, round(median(na), 5) AS median_nse_a, round(quantile_cont(nb, 0.1), 5) AS p10_nse_b,
round(median(abs(nb - na)), 5) AS median_delta, round(quantile_cont(abs(nb - na), 0.95), 5) AS p95_delta, round(max(abs(nb - na)), 5) AS max_delta FROM s GROUP BY 1""", "forecast")
def delta_profile(spark, d):
    out = models.delta_profile(_deltas(spark, d), "lead")
    return out.select("lead", "basins", "without_score", "missing_a", *[R(c, 5).alias(c) for c in ("median_nse_a", "p10_nse_b", "median_delta", "p95_delta", "max_delta")])


@query("compared_grids", """WITH a AS (SELECT lat_idx, lon_idx, week, CASE WHEN (lat_idx + lon_idx) % 7 > 0 THEN round(value, 1) END AS v FROM grid), b AS (SELECT lat_idx, lon_idx, (week + 7)::DATE AS week, CASE WHEN lon_idx % 5 > 0 THEN round(value, 1) END AS v FROM grid),
j AS (SELECT week, a.v AS x, b.v AS y, a.v - b.v AS e FROM a FULL JOIN b USING (lat_idx, lon_idx, week))
SELECT week, count(*) AS cells, count(e) AS both_valid, count(*) FILTER (x IS NULL AND y IS NULL) AS both_missing, count(*) FILTER (x IS NULL AND y IS NOT NULL) AS rebuilt_missing, count(*) FILTER (x IS NOT NULL AND y IS NULL) AS reference_missing,
round(100.0 * count(e) / count(*), 6) AS both_valid_percent, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, round(quantile_cont(abs(e), 0.5), 6) AS p50, round(quantile_cont(abs(e), 0.95), 6) AS p95, round(max(abs(e)), 6) AS max,
round(avg((abs(e) <= 1e-5)::INT), 6) AS near_equal, round(avg((e = 0)::INT), 6) AS equal, round(avg(x) FILTER (e IS NOT NULL), 6) AS rebuilt_mean, round(stddev_pop(y) FILTER (e IS NOT NULL), 6) AS reference_std FROM j GROUP BY 1""", "grid")
def compared_grids(spark, d):
    g = base.grid(spark, d).withColumn("value", F.round("value", 1))
    rebuilt = g.withColumn("value", F.when((F.col("lat_idx") + F.col("lon_idx")) % 7 > 0, F.col("value")))
    reference = g.withColumn("week", F.date_add("week", 7)).withColumn("value", F.when(F.col("lon_idx") % 5 > 0, F.col("value")))
    out = models.compare_grids(rebuilt, reference, ["lat_idx", "lon_idx"], ["week"], "value")
    rounded = ["both_valid_percent", "mae", "rmse", "bias", "p50", "p95", "max", "near_equal", "equal", "rebuilt_mean", "reference_std"]
    return out.select("week", "cells", "both_valid", "both_missing", "rebuilt_missing", "reference_missing", *[R(c).alias(c) for c in rounded])


@query("window_forecast", """SELECT basin, date, ceil(lead * 9 / 24.0)::BIGINT AS day, round(avg(obs), 6) AS mean, sum(obs) AS total FROM forecast GROUP BY 1, 2, 3""", "forecast")
def window_forecast(spark, d):
    return models.window_forecast(base.forecast(spark, d), ["basin", "date"], F.col("lead") * 9, "obs").withColumn("mean", R("mean"))


@query("subbasin_climate", """SELECT basin, CASE WHEN sum(overlap) FILTER (sub_id % 7 <> 0) / sum(overlap) >= 0.8 THEN round(sum(overlap * class) FILTER (sub_id % 7 <> 0) / sum(overlap) FILTER (sub_id % 7 <> 0), 6) END AS value FROM fragments GROUP BY 1""", "fragments")
def subbasin_climate(spark, d):
    from freshet.operators import zonal

    f = base.fragments(spark, d).withColumn("idx", F.when(F.col("sub_id") % 7 != 0, F.col("class")))
    return zonal.requested_mean(f, "basin", "overlap", "idx").withColumn("value", R("value"))


@query("stored_units", """WITH s AS (SELECT event_id, user_id, value, (['precip', 'mslp', 'temp', 'u10'])[event_id % 4 + 1] AS stream, (event_id // 4) % 3 AS u, avg(value * 10) OVER (PARTITION BY user_id, event_id % 4) AS m FROM events),
k AS (SELECT *, CASE stream WHEN 'precip' THEN greatest(0, value) * ([3600, 1, 1 / 24.0::DOUBLE])[u + 1] WHEN 'mslp' THEN (CASE WHEN u = 1 THEN value ELSE value / 100 END) - 1000
WHEN 'temp' THEN CASE WHEN u = 1 OR (u = 0 AND m > 150) THEN value * 10 - 273.15 ELSE value * 10 END ELSE value END AS stored FROM s)
SELECT event_id, round(stored, 6) AS stored, round(CASE WHEN stream = 'mslp' THEN stored + 1000 ELSE stored END, 6) AS back FROM k""")
def stored_units(spark, d):
    k = F.col("event_id")
    pick = lambda names, i: F.get(F.array(*[F.lit(n).cast("string") for n in names]), i.cast("int"))
    e = base.read(spark, d, "events").withColumn("stream", pick(["precip", "mslp", "temp", "u10"], k % 4)).withColumn("u", F.floor(k / 4) % 3)
    units = F.when(F.col("stream") == "precip", pick([None, "mm/h", "mm/day"], F.col("u"))).when(F.col("stream") == "mslp", pick([None, "hPa", "Pa"], F.col("u"))).when(F.col("stream") == "temp", pick([None, "K", "degC"], F.col("u")))
    v = F.when(F.col("stream") == "temp", F.col("value") * 10).otherwise(F.col("value"))
    e = e.withColumn("v", v).withColumn("mean", F.avg(F.col("value") * 10).over(Window.partitionBy("user_id", k % 4)))
    stored = frame.to_stored_units(F.col("stream"), F.col("v"), units, F.col("mean"))
    e = e.select("event_id", "stream", stored.alias("stored"))
    return e.select("event_id", R("stored").alias("stored"), R(frame.from_stored_units(F.col("stream"), F.col("stored"))).alias("back"))


@query("physical_units", """SELECT s_suppkey, round(s_acctbal * 0.1, 6) AS s_acctbal, round(s_nationkey * 10.0::DOUBLE, 6) AS s_nationkey FROM supplier""")
def physical_units(spark, d):
    s = base.read(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    out = frame.to_physical_units(s, {"s_acctbal": 0.1, "s_nationkey": 10.0}, ["s_acctbal", "s_nationkey"])
    return out.select("s_suppkey", R("s_acctbal").alias("s_acctbal"), R("s_nationkey").alias("s_nationkey"))


@query("parsed_ids", """SELECT c_custkey, 'camels' AS subdataset, lpad((c_custkey % 1000000000)::VARCHAR, 9, '0') AS link, regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM customer""")
def parsed_ids(spark, d):
    c = base.read(spark, d, "customer")
    return c.select("c_custkey", frame.subdataset(F.concat(F.lit("camels_"), F.col("c_custkey").cast("string"))).alias("subdataset"), frame.link_id(F.col("c_custkey")).alias("link"), frame.safe_id(F.col("c_name")).alias("safe"))


@query("shifted_grid", """SELECT lat_idx * 30 - 90 AS lat, CASE WHEN lon_idx * 30 >= 180 THEN lon_idx * 30 - 360 ELSE lon_idx * 30 END AS lon, week, CASE WHEN value < 25 THEN NULL ELSE round(value - 25, 6) END AS value FROM grid""", "grid")
def shifted_grid(spark, d):
    g = base.grid(spark, d).select((F.col("lat_idx") * 30 - 90).cast("long").alias("lat"), (F.col("lon_idx") * 30).cast("long").alias("lon"), "week", (F.col("value") - 25).alias("value"))
    return frame.flip_shift_grid(g, "lon", "value").withColumn("value", R("value"))


@query("distinct_entities", """SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1""")
def distinct_entities(spark, d):
    return base.read(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("snapped_reaches", f"""WITH p AS (SELECT point_id, lat, lon, reach_id, lat1, lon1, lat2, area, {_F} AS f FROM gauges, streams), k AS (SELECT point_id, reach_id, area, {_KM} AS km FROM p)
SELECT point_id, arg_min(reach_id, (round(km / (1 + log10(greatest(1, area)) * 0.3), 9), reach_id)) AS reach_id, round(arg_min(km, (round(km / (1 + log10(greatest(1, area)) * 0.3), 9), reach_id)), 5) AS km FROM k WHERE km <= 150 GROUP BY 1""", "gauges streams")
def snapped_reaches(spark, d):
    return snapping.snap_to_reach(gauges(spark, d), streams(spark, d), 150.0, 0.3).withColumn("km", R("km", 5))


@query("snapped_by_area", f"""WITH p AS (SELECT point_id, target_area, lat, lon, reach_id, lat1, lon1, lat2, area, {_F} AS f FROM gauges, streams),
k AS (SELECT point_id, reach_id, area, target_area, {_KM} AS km FROM p), s AS (SELECT point_id, reach_id, km, CASE WHEN km <= 60 THEN 0 ELSE 1 END AS tier, round(km / (1 + log10(greatest(1, area)) * 0.3), 9) AS score FROM k
 WHERE km <= 200 AND greatest(area / target_area, target_area / area) <= CASE WHEN km <= 60 THEN 50 ELSE 8 END)
SELECT g.point_id, arg_min(reach_id, (tier, score, reach_id)) AS reach_id, round(arg_min(km, (tier, score, reach_id)), 5) AS km, arg_min(tier, (tier, score, reach_id)) AS tier FROM gauges g LEFT JOIN s USING (point_id) GROUP BY 1""", "gauges streams")
def snapped_by_area(spark, d):
    return snapping.snap_by_area(gauges(spark, d), streams(spark, d), 60.0, 200.0, 50.0, 8.0, 0.3).withColumn("km", R("km", 5))


@query("threshold_lookup", """WITH g AS (SELECT point_id, lat, lon, CASE WHEN target_area IS NULL OR target_area = 0 THEN 500 ELSE greatest(target_area, 50) END AS a FROM (SELECT point_id, lat, lon, CASE WHEN point_id % 11 > 0 THEN target_area END AS target_area FROM gauges)),
c AS (SELECT point_id, reach_id, a, greatest(area, 10) AS s, area / 3 - 200 AS two, area AS five, area * 2 AS twenty, sqrt(power(lat - lat1, 2) + power((((lon1 - lon + 540) % 360) - 180) * cos(radians(lat)), 2)) AS d FROM g, streams WHERE area / 3 - 200 > 0),
n AS (SELECT *, round(abs(ln(s / a)) + 2 * d, 9) AS score, least(2.5, greatest(0.4, power(a / s, 0.75))) AS k FROM c WHERE d <= 0.45 AND s BETWEEN 0.33 * a AND 3 * a),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY score, reach_id) = 1)
SELECT g.point_id, reach_id, round(coalesce(two * k, 0.365 * power(g.a, 0.75)), 5) AS two, round(coalesce(five * k, 1.66 * 0.365 * power(g.a, 0.75)), 5) AS five, round(coalesce(twenty * k, 2.5 * 0.365 * power(g.a, 0.75)), 5) AS twenty FROM g LEFT JOIN b USING (point_id)""", "gauges streams")
def threshold_lookup(spark, d):
    area = F.col("area")
    own = streams(spark, d).select("reach_id", "area", F.col("lat1").alias("lat"), F.col("lon1").alias("lon"), (area / 3 - 200).alias("two"), area.alias("five"), (area * 2).alias("twenty"))
    points = gauges(spark, d).withColumn("target_area", F.when(F.col("point_id") % 11 > 0, F.col("target_area")))
    out = snapping.threshold_lookup(points, own, ["two", "five", "twenty"])
    return out.select("point_id", "reach_id", *[R(c, 5).alias(c) for c in ("two", "five", "twenty")])


@query("box_overlaps", """WITH a AS (SELECT point_id AS id, lat AS s, lon AS w, lat + 3 AS n, lon + 4.5 AS e FROM gauges), b AS (SELECT reach_id AS id, lat1 AS s, lon1 AS w, lat1 + 5 AS n, lon1 + 6 AS e FROM streams),
o AS (SELECT a.id AS a_id, b.id AS b_id, (least(a.n, b.n) - greatest(a.s, b.s)) * (least(a.e, b.e) - greatest(a.w, b.w)) AS o FROM a JOIN b ON a.s < b.n AND b.s < a.n AND a.w < b.e AND b.w < a.e)
SELECT a_id, b_id, round(o, 6) AS overlap, round(o / (13.5 + 30 - o), 6) AS iou, round(2 * o / 43.5, 6) AS dice FROM o WHERE o > 1e-9""", "gauges streams")
def box_overlaps(spark, d):
    box = lambda df, i, lat, lon, h, w: df.select(F.col(i).alias("id"), F.col(lat).alias("south"), F.col(lon).alias("west"), (F.col(lat) + h).alias("north"), (F.col(lon) + w).alias("east"))
    iou, dice, _ = snapping.iou_dice(F.col("overlap"), F.col("a_area"), F.col("b_area"))
    values = {"overlap": R("overlap"), "iou": R(iou), "dice": R(dice)}
    return snapping.overlap_boxes(box(gauges(spark, d), "point_id", "lat", "lon", 3, 4.5), box(streams(spark, d), "reach_id", "lat1", "lon1", 5, 6), 5.0, 1e-9, values)


@query("domain_coverage", """WITH c AS (SELECT point_id, greatest(0, least(lat + 3, 60) - greatest(lat, -60)) * greatest(0, least(lon + 4.5, 150) - greatest(lon, -150)) / 13.5 AS share FROM gauges)
SELECT point_id, round(share, 6) AS share, CASE WHEN round(share, 6) >= 0.8 THEN point_id END AS kept FROM c""", "gauges")
def domain_coverage(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    share = R(snapping.domain_coverage(lat, lon, lat + 3, lon + 4.5, (-60.0, -150.0, 60.0, 150.0)))
    return gauges(spark, d).select("point_id", share.alias("share"), F.when(share >= 0.8, F.col("point_id")).alias("kept"))


@query("line_ranks", """WITH r AS (SELECT (p_partkey // 12) % 6 AS lat_idx, p_partkey % 12 AS lon_idx, max(p_size) AS rank FROM part GROUP BY 1, 2),
v AS (SELECT c_custkey, (c_custkey + i) % 6 AS lat_idx, (c_custkey * 5 + i) % 12 AS lon_idx FROM customer, (SELECT unnest(range(12)) AS i)) SELECT c_custkey, coalesce(max(rank), 0) AS rank FROM v LEFT JOIN r USING (lat_idx, lon_idx) GROUP BY 1""")
def line_ranks(spark, d):
    ranks = base.read(spark, d, "part").groupBy((F.floor(F.col("p_partkey") / 12) % 6).alias("lat_idx"), (F.col("p_partkey") % 12).alias("lon_idx")).agg(F.max("p_size").alias("rank"))
    k = F.col("c_custkey")
    vertices = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(((k + i) % 6).cast("bigint").alias("lat_idx"), ((k * 5 + i) % 12).cast("bigint").alias("lon_idx")))
    return snapping.max_rank(base.read(spark, d, "customer").select(k, vertices.alias("vertices")), ranks, "c_custkey", ["lat_idx", "lon_idx"], every=True)


@query("queried_reaches", """SELECT reach_id, lat1 AS lat, lon1 AS lon, area FROM streams WHERE (lon1 >= 100 OR lon1 <= -100) AND lat1 BETWEEN -50 AND 60 AND reach_id % 9 >= 3 AND area >= 2000""", "streams")
def queried_reaches(spark, d):
    own = streams(spark, d).select("reach_id", F.col("lat1").alias("lat"), F.col("lon1").alias("lon"), "area", (F.col("reach_id") % 9).alias("order"))
    return snapping.query_reaches(own, 100, -50, -100, 60, 3, 2000.0).drop("order")
