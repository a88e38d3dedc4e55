"""Queries on basin series, grids, attributes and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.functions import weather
from freshet.operators import climate, frame, skill, zonal
from freshet.plans import base
from freshet.plans.base import query

R = lambda c, n=6: F.round(c, n)


@query("zonal_reduce", """SELECT basin, week, CASE WHEN w / whole >= 0.8 - 1e-6 THEN round(wx / w, 6) END AS value, round(greatest(0, 1 - w / whole), 6) AS missing_fraction
FROM (SELECT basin, week, sum(weight * value) AS wx, sum(weight) AS w FROM grid JOIN weights USING (lat_idx, lon_idx) GROUP BY 1, 2)
JOIN (SELECT basin, sum(weight) AS whole FROM weights GROUP BY 1) USING (basin)""", "grid weights")
def zonal_reduce(spark, d):
    out = zonal.zonal_reduce(base.grid(spark, d), base.weights(spark, d), ["week"])
    return out.select("basin", "week", R("value").alias("value"), R("missing_fraction").alias("missing_fraction"))


@query("basin_summary", """SELECT basin, week, CASE WHEN w / whole >= 0.8 - 1e-6 THEN round(wx / w, 6) END AS value, round(m, 6) AS max_cell
FROM (SELECT basin, week, sum(weight * value) AS wx, sum(weight) AS w, max(value) AS m FROM grid JOIN weights USING (lat_idx, lon_idx) GROUP BY 1, 2)
JOIN (SELECT basin, sum(weight) AS whole FROM weights GROUP BY 1) USING (basin)""", "grid weights")
def basin_summary(spark, d):
    out = zonal.basin_summary(base.grid(spark, d), base.weights(spark, d), ["week"])
    return out.select("basin", "week", R("value").alias("value"), R("max_cell").alias("max_cell"))


@query("ensemble_stats", """SELECT basin, date, count(value) AS members, round(avg(value), 4) AS mean, CASE WHEN count(value) >= 2 THEN round(stddev_samp(value), 4) END AS std, min(value) AS min, max(value) AS max,
round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90 FROM ensemble GROUP BY 1, 2""", "ensemble")
def ensemble_stats(spark, d):
    out = zonal.ensemble_stats(base.ensemble(spark, d), ["basin", "date"])
    return out.select("basin", "date", "members", *[R(c, 4).alias(c) for c in ("mean", "std", "p10", "p50", "p90")], "min", "max")


@query("member_percentiles", """SELECT basin, date, round(avg(value), 4) AS mean, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, max(value) AS max
FROM ensemble WHERE value >= 0 GROUP BY 1, 2""", "ensemble")
def member_percentiles(spark, d):
    out = zonal.member_percentiles(base.ensemble(spark, d), ["basin", "date"])
    return out.select("basin", "date", *[R(c, 4).alias(c) for c in ("mean", "min", "p25", "p50", "p75", "max")])


@query("daily_mean", "SELECT event_type, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def daily_mean(spark, d):
    return zonal.daily_mean(base.read(spark, d, "events"), ["event_type"], "ts", "value").select("event_type", "date", R("value").alias("value"))


@query("daily_sum_complete", """SELECT event_type, date, CASE WHEN count(v) = 24 THEN round(sum(v) * 1.0, 6) END AS total, count(v) AS slots FROM
(SELECT event_type, CAST(ts AS DATE) AS date, hour(ts) AS slot, avg(value) AS v FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def daily_sum_complete(spark, d):
    out = zonal.daily_sum_complete(base.read(spark, d, "events"), ["event_type"], "ts", "value", 24, 1.0)
    return out.select("event_type", "date", R("total").alias("total"), "slots")


@query("plane_completeness", """WITH c AS (SELECT basin, lead, count(sim) AS cells FROM forecast GROUP BY 1, 2),
f AS (SELECT *, first_value(cells) OVER (PARTITION BY basin ORDER BY lead) AS first_cells FROM c) SELECT basin, lead, cells, first_cells, cells < 0.99 * first_cells AS deficient FROM f""", "forecast")
def plane_completeness(spark, d):
    return zonal.plane_completeness(base.forecast(spark, d), "basin", "lead", "sim")


@query("bin_average", """SELECT CAST(floor((lat + 90) / 10) AS BIGINT) AS lat_idx, CAST(floor((lon + 180) / 10) AS BIGINT) AS lon_idx, round(avg(point_id), 6) AS point_id, count(point_id) AS n FROM points GROUP BY 1, 2""", "points")
def bin_average(spark, d):
    return zonal.bin_average(base.points(spark, d), "lat", "lon", "point_id", 10.0).select("lat_idx", "lon_idx", R("point_id").alias("point_id"), "n")


@query("area_weighted_mean", "SELECT basin, round(sum(overlap * class) / sum(overlap), 6) AS mean FROM fragments WHERE class > -900 GROUP BY 1", "fragments")
def area_weighted_mean(spark, d):
    return zonal.area_weighted_mean(base.fragments(spark, d), "basin", "overlap", "class").select("basin", R("mean").alias("mean"))


@query("weighted_majority", """SELECT basin, class AS majority FROM (SELECT basin, class, row_number() OVER (PARTITION BY basin ORDER BY sum(overlap) DESC, class) AS r FROM fragments GROUP BY 1, 2) WHERE r = 1""", "fragments")
def weighted_majority(spark, d):
    return zonal.weighted_majority(base.fragments(spark, d), "basin", "overlap", "class")


@query("coverage_fraction", "SELECT basin, round(sum(CASE WHEN class < 4 THEN overlap ELSE 0 END) / sum(overlap), 6) AS coverage, round(sum(overlap), 4) AS area FROM fragments GROUP BY 1", "fragments")
def coverage_fraction(spark, d):
    out = zonal.coverage_fraction(base.fragments(spark, d), "basin", F.col("class") < 4, "overlap")
    return out.select("basin", R("coverage").alias("coverage"), R("area", 4).alias("area"))


@query("densify_daily", """SELECT basin, date, q FROM (SELECT basin, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM flow GROUP BY 1) LEFT JOIN flow USING (basin, date)""", "flow")
def densify_daily(spark, d):
    return frame.densify_daily(base.flow(spark, d), "basin", "date").select("basin", "date", "q")


@query("band_transform", "SELECT basin, date, greatest(q * 0.5 - 10, 0) AS q FROM flow", "flow")
def band_transform(spark, d):
    return frame.apply_band_transform(base.flow(spark, d), "q", 0.5, -10.0, 0.0)


@query("temp_to_celsius", "SELECT basin, date, CASE WHEN avg(q) OVER (PARTITION BY basin) > 150 THEN q - 273.15 ELSE q END AS q FROM flow", "flow")
def temp_to_celsius(spark, d):
    return frame.temp_to_celsius(base.flow(spark, d), "q", ["basin"])


@query("normalise_pet_sign", "SELECT s_suppkey, s_nationkey, CASE WHEN avg(s_acctbal) OVER (PARTITION BY s_nationkey) < 0 THEN -s_acctbal ELSE s_acctbal END AS s_acctbal FROM supplier")
def normalise_pet_sign(spark, d):
    return frame.normalise_pet_sign(base.read(spark, d, "supplier"), "s_acctbal", ["s_nationkey"]).select("s_suppkey", "s_nationkey", "s_acctbal")


@query("discharge_units", "SELECT basin, date, round(q * 86.4 / 1000, 8) AS mm_day, round(q / 0.028316846592, 6) AS cubic_feet FROM flow", "flow")
def discharge_units(spark, d):
    q = F.col("q")
    return base.flow(spark, d).select("basin", "date", R(frame.specific_discharge(q, F.lit(1000.0)), 8).alias("mm_day"), R(frame.cubic_feet(q)).alias("cubic_feet"))


@query("filter_bbox", "SELECT point_id, lat, lon FROM points WHERE lat BETWEEN -30 AND 45 AND (lon >= 150 OR lon <= -120)", "points")
def filter_bbox(spark, d):
    return frame.filter_bbox(base.points(spark, d), 150, -30, -120, 45)


@query("filter_period", "SELECT basin, date, q FROM flow WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-09-30' OR date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'", "flow")
def filter_period(spark, d):
    return frame.filter_period(base.flow(spark, d), "date", [("1996-03-01", "1996-09-30"), ("1999-01-01", "1999-06-30")])


@query("parse_finite", r"""SELECT event_id, CASE WHEN regexp_full_match(trim(x), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim(x) AS DOUBLE) END AS v
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN ' ' || user_id || '.5' ELSE 'inf' END AS x FROM events)""")
def parse_finite(spark, d):
    k = F.col("event_id") % 3
    x = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".5"))).otherwise("inf")
    return base.read(spark, d, "events").select("event_id", frame.parse_finite(x).alias("v"))


@query("catalogue_top", "SELECT s_suppkey AS point_id, s_acctbal + 1000 AS area FROM supplier WHERE s_acctbal + 1000 >= 2000 ORDER BY area DESC, point_id LIMIT 20")
def catalogue_top(spark, d):
    s = base.read(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_acctbal") + 1000).alias("area"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    return frame.filter_catalog(s, (-180, -90, 180, 90), 2000, 20).select("point_id", "area")


@query("skip_all_missing", """SELECT basin, date, q FROM (SELECT *, CASE WHEN basin % 3 = 0 THEN NULL ELSE q END AS v FROM flow) f
WHERE basin IN (SELECT basin FROM flow WHERE basin % 3 <> 0 AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31')""", "flow")
def skip_all_missing(spark, d):
    f = base.flow(spark, d).withColumn("v", F.when(F.col("basin") % 3 != 0, F.col("q")))
    return frame.skip_all_missing(f, "basin", "date", "v", [("1996-01-01", "1996-12-31")]).select("basin", "date", "q")


@query("forecast_by_valid_date", """SELECT o.basin, o.date, f.date AS issue, f.lead, round(f.sim, 6) AS forecast, o.q FROM flow o JOIN forecast f ON o.basin = f.basin AND o.date = f.date + (f.lead - 1)""", "flow forecast")
def forecast_by_valid_date(spark, d):
    fc = base.forecast(spark, d).select("basin", F.col("date").alias("issue"), "lead", R("sim").alias("forecast"))
    return frame.attach_forecast_by_valid_date(base.flow(spark, d), fc).select("basin", "date", "issue", "lead", "forecast", "q")


@query("merge_best_coverage", """WITH o AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal END AS v, (s_suppkey % 7) / 10.0::DOUBLE AS f FROM supplier WHERE s_suppkey % 5 <> 0),
n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal * 2 END AS v, (s_suppkey % 3) / 10.0::DOUBLE AS f FROM supplier)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN b THEN nv ELSE ov END AS v, CASE WHEN b THEN nf ELSE fo END AS f FROM
(SELECT o.k AS ok, n.k AS nk, o.v AS ov, n.v AS nv, o.f AS fo, n.f AS nf, coalesce(n.v IS NOT NULL AND (o.v IS NULL OR o.f IS NULL OR n.f < o.f - 1e-5), false) AS b FROM o FULL JOIN n ON o.k = n.k) x
LEFT JOIN o ON o.k = x.ok LEFT JOIN n ON n.k = x.nk""")
def merge_best_coverage(spark, d):
    s, k = base.read(spark, d, "supplier"), F.col("s_suppkey")
    old = s.where(k % 5 != 0).select(k.alias("k"), F.when(k % 4 != 0, F.col("s_acctbal")).alias("v"), (k % 7 / 10.0).alias("f"))
    new = s.select(k.alias("k"), F.when(k % 6 != 0, F.col("s_acctbal") * 2).alias("v"), (k % 3 / 10.0).alias("f"))
    return frame.merge_best_coverage(old, new, ["k"], "v", "f")


@query("carry_forward", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, -1.0 FROM supplier WHERE s_suppkey % 3 <> 0")
def carry_forward(spark, d):
    s = base.read(spark, d, "supplier")
    return frame.carry_forward(s.select(F.col("s_suppkey").alias("k"), F.lit(-1.0).alias("v")), s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), "k")


@query("update_columns", "SELECT s.s_suppkey, s.s_nationkey, u.v AS s_acctbal FROM supplier s LEFT JOIN (SELECT s_suppkey, s_acctbal * 3 AS v FROM supplier WHERE s_suppkey % 2 = 0) u USING (s_suppkey)")
def update_columns(spark, d):
    s = base.read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return frame.update_columns(s, s.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") * 3), "s_suppkey", ["s_acctbal"])


@query("source_priority", """WITH t AS (SELECT s_suppkey AS k, 0 AS source_rank, s_acctbal AS v FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 1, s_acctbal + 1 FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 2, s_acctbal + 2 FROM supplier)
SELECT k, v, source_rank FROM t QUALIFY source_rank = min(source_rank) OVER (PARTITION BY k)""")
def source_priority(spark, d):
    s = base.read(spark, d, "supplier")
    one = lambda m, i: s.where(F.col("s_suppkey") % m == 0).select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") + i).alias("v"))
    return frame.select_source_by_priority([one(4, 0), one(2, 1), one(1, 2)], "k").select("k", "v", "source_rank")


@query("merge_features", "SELECT basin, date, a.q AS q, b.sim AS sim FROM flow a FULL JOIN (SELECT basin, date, round(sim, 6) AS sim FROM obs_sim WHERE sim IS NOT NULL AND basin % 2 = 0) b USING (basin, date)", "flow obs_sim")
def merge_features(spark, d):
    sims = base.obs_sim(spark, d).where(F.col("sim").isNotNull() & (F.col("basin") % 2 == 0)).select("basin", "date", R("sim").alias("sim"))
    return frame.merge_features([base.flow(spark, d), sims], ["basin", "date"])


@query("first_store_wins", "SELECT s_suppkey AS k, a.s_acctbal AS x, b.y FROM supplier a LEFT JOIN (SELECT s_suppkey, s_nationkey * 2 AS y FROM supplier WHERE s_suppkey % 2 = 1) b USING (s_suppkey)")
def first_store_wins(spark, d):
    s, k = base.read(spark, d, "supplier"), F.col("s_suppkey").alias("k")
    return frame.first_store_wins([s.select(k, F.col("s_acctbal").alias("x")), s.where("s_suppkey % 2 = 1").select(k, F.lit(0.0).alias("x"), (F.col("s_nationkey") * 2).alias("y"))], "k")


@query("align_canonical", "SELECT basin, date, round(sim, 6) AS sim FROM (SELECT basin, date FROM flow) LEFT JOIN obs_sim USING (basin, date)", "flow obs_sim")
def align_canonical(spark, d):
    return frame.align_canonical(base.flow(spark, d), base.obs_sim(spark, d).select("basin", "date", R("sim").alias("sim")), ["basin", "date"])


@query("basin_selection", "SELECT s_suppkey, s_nationkey FROM supplier s WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49 AND l.l_returnflag = 'R' AND l.l_linenumber = 7)")
def basin_selection(spark, d):
    s = base.read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    wanted = base.read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    bad = base.read(spark, d, "lineitem").where("l_quantity > 49 AND l_returnflag = 'R' AND l_linenumber = 7").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(wanted, "s_nationkey", "left_semi").join(bad, "s_suppkey", "left_anti")


@query("except_dates", """SELECT basin, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM flow GROUP BY 1 EXCEPT SELECT basin, date FROM flow""", "flow")
def except_dates(spark, d):
    f = base.flow(spark, d).select("basin", "date")
    return frame.densify_daily(f, "basin", "date").select("basin", "date").subtract(f)


@query("intersect_basins", "SELECT basin, date FROM flow INTERSECT SELECT basin, date FROM obs_sim WHERE sim IS NOT NULL", "flow obs_sim")
def intersect_basins(spark, d):
    return base.flow(spark, d).select("basin", "date").intersect(base.obs_sim(spark, d).where("sim IS NOT NULL").select("basin", "date"))


@query("dedupe_max_area", "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1")
def dedupe_max_area(spark, d):
    return frame.dedupe_max(base.read(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_nationkey", "s_acctbal", "s_suppkey")


@query("deaccumulate", "SELECT basin, date, greatest(q - coalesce(lag(q) OVER (PARTITION BY basin ORDER BY date), 0), 0) AS q FROM flow", "flow")
def deaccumulate(spark, d):
    return frame.deaccumulate(base.flow(spark, d), ["basin"], "date", "q")


@query("spells", """WITH m AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY date) - row_number() OVER (PARTITION BY basin, q > 60 ORDER BY date) AS g FROM flow),
r AS (SELECT basin, g, count(*) AS n FROM m WHERE q > 60 GROUP BY 1, 2) SELECT basin, count(*) AS spells, round(avg(n), 6) AS mean_length, max(n) AS longest FROM r GROUP BY 1""", "flow")
def spells(spark, d):
    return frame.spells(base.flow(spark, d), "basin", "date", F.col("q") > 60).select("basin", "spells", R("mean_length").alias("mean_length"), "longest")


@query("up_crossings", """SELECT basin, date, q FROM (SELECT *, lag(q) OVER w AS b, row_number() OVER w AS r FROM flow WINDOW w AS (PARTITION BY basin ORDER BY date)) WHERE q >= 100 AND (r = 1 OR b < 100)""", "flow")
def up_crossings(spark, d):
    f = base.flow(spark, d)
    return f.withColumn("c", frame.up_crossings(f, "basin", "date", "q", F.lit(100.0))).where("c").drop("c")


@query("cumulative_rain", "SELECT basin, date, sum(q) OVER (PARTITION BY basin ORDER BY date ROWS UNBOUNDED PRECEDING) AS total FROM flow", "flow")
def cumulative_rain(spark, d):
    return frame.cumulative(base.flow(spark, d), ["basin"], "date", F.col("q"), "total").drop("q")


@query("sequence_valid", """SELECT basin, date, count(*) OVER w = 7 AND min(CASE WHEN sim IS NULL THEN 0 ELSE 1 END) OVER w = 1 AS every, count(*) OVER w = 7 AND max(CASE WHEN sim IS NULL THEN 0 ELSE 1 END) OVER w = 1 AS any
FROM obs_sim WINDOW w AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)""", "obs_sim")
def sequence_valid(spark, d):
    ok = F.col("sim").isNotNull()
    return base.obs_sim(spark, d).select("basin", "date", frame.sequence_valid(ok, "basin", "date", 7, 2).alias("every"), frame.sequence_valid(ok, "basin", "date", 7, 2, every=False).alias("any"))


@query("window_peak", """SELECT basin, date AS peak_date, q AS peak FROM flow QUALIFY row_number() OVER (PARTITION BY basin ORDER BY date >= DATE '2000-06-01' DESC, q DESC, date) = 1""", "flow")
def window_peak(spark, d):
    return frame.window_peak(base.flow(spark, d), "basin", "date", "q", "2000-06-01")


@query("last_valid_date", """SELECT max(date) AS last_valid FROM (SELECT date, count(DISTINCT basin) AS n FROM obs_sim WHERE sim IS NOT NULL GROUP BY 1) WHERE n = (SELECT count(DISTINCT basin) FROM flow)""", "obs_sim flow")
def last_valid_date(spark, d):
    return frame.last_valid_date(base.obs_sim(spark, d), "basin", "date", "sim")


@query("product_latency", "SELECT basin, max(CASE WHEN sim IS NOT NULL THEN date END) AS last_valid, date_diff('day', max(CASE WHEN sim IS NOT NULL THEN date END), DATE '2001-12-31')::INT AS missing_days FROM obs_sim GROUP BY 1", "obs_sim")
def product_latency(spark, d):
    return frame.latency(base.obs_sim(spark, d), "basin", "date", "sim", "2001-12-31")


@query("flow_duration_curve", "SELECT basin, q, rank, round(exceedance, 9) AS exceedance FROM (SELECT basin, q, row_number() OVER (PARTITION BY basin ORDER BY q DESC) AS rank, row_number() OVER (PARTITION BY basin ORDER BY q DESC) / (count(*) OVER (PARTITION BY basin) + 1) AS exceedance FROM flow)", "flow")
def flow_duration_curve(spark, d):
    return frame.flow_duration(base.flow(spark, d), "basin", "q").select("basin", "q", "rank", R("exceedance", 9).alias("exceedance"))


@query("stratified_sample", "SELECT s_suppkey, s_nationkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(s_suppkey::VARCHAR), s_suppkey) <= 2")
def stratified_sample(spark, d):
    return frame.stratified_sample(base.read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], "s_suppkey", 2)


@query("percentile_profile", "SELECT basin, " + ", ".join(f"round(quantile_cont(q, {s}), 6) AS \"p{s * 100:g}\"" for s in (0.0, 0.01, 0.05, 0.1, 0.25, 0.5)) + " FROM flow GROUP BY 1", "flow")
def percentile_profile(spark, d):
    out = frame.percentile_profile(base.flow(spark, d), ["basin"], "q")
    return out.select("basin", *[R(c).alias(c) for c in out.columns[1:]])


@query("feature_stats", """SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.5), 6) AS median FROM
(SELECT 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY 1""")
def feature_stats(spark, d):
    out = frame.feature_stats(base.read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("feature", *[R(c).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query("scaled_features", """WITH l AS (SELECT basin, date, 'obs' AS feature, obs AS v FROM obs_sim UNION ALL SELECT basin, date, 'sim', sim FROM obs_sim),
s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY 1) SELECT basin, date, feature, round((v - m) / s, 6) AS z FROM l JOIN s USING (feature)""", "obs_sim")
def scaled_features(spark, d):
    f = base.obs_sim(spark, d)
    return frame.scaled(f, frame.feature_stats(f, ["obs", "sim"]), ["obs", "sim"], ["basin", "date"]).withColumn("z", R("z"))


@query("per_basin_std", "SELECT basin, round(stddev_pop(q), 6) AS std FROM flow GROUP BY 1", "flow")
def per_basin_std(spark, d):
    return base.flow(spark, d).groupBy("basin").agg(R(F.stddev_pop("q")).alias("std"))


_TIER = "CASE WHEN a < 1500 THEN 'micro' WHEN a < 3500 THEN 'small' WHEN a < 6000 THEN 'medium' WHEN a < 9000 THEN 'large' ELSE 'macro' END"


@query("size_tiers", f"SELECT s_nationkey, tier, count(*) AS basins, round(avg(a), 6) AS mean_area FROM (SELECT s_nationkey, a, {_TIER} AS tier FROM (SELECT s_nationkey, s_acctbal + 1000 AS a FROM supplier)) GROUP BY GROUPING SETS ((s_nationkey), (tier), ())")
def size_tiers(spark, d):
    s = base.read(spark, d, "supplier").select("s_nationkey", (F.col("s_acctbal") + 1000).alias("a")).withColumn("tier", weather.size_tier(F.col("a")))
    return s.groupingSets([[F.col("s_nationkey")], [F.col("tier")], []], F.col("s_nationkey"), F.col("tier")).agg(F.count(F.lit(1)).alias("basins"), R(F.avg("a")).alias("mean_area"))


_SKILL = """count(*) AS n, round(1 - avg((sim - obs)^2) / var_pop(obs), 6) AS nse, round(avg((sim - obs)^2), 4) AS mse, round(sqrt(avg((sim - obs)^2)), 6) AS rmse, round(stddev_pop(sim) / stddev_pop(obs), 6) AS alpha_nse,
round((avg(sim) - avg(obs)) / stddev_pop(obs), 6) AS beta_nse, round(avg(sim) / avg(obs), 6) AS beta_kge,
round(1 - sqrt((corr(obs, sim) - 1)^2 + (stddev_pop(sim) / stddev_pop(obs) - 1)^2 + (avg(sim) / avg(obs) - 1)^2), 6) AS kge, round(corr(obs, sim), 6) AS pearson_r"""


def _rounded(df, keys):
    return df.select(*keys, *[c if c in ("n",) else R(c, 4 if c == "mse" else 6).alias(c) for c in df.columns if c not in keys])


@query("skill", f"SELECT basin, {_SKILL} FROM obs_sim WHERE obs IS NOT NULL AND sim IS NOT NULL GROUP BY 1", "obs_sim")
def skill_all(spark, d):
    return _rounded(skill.skill(base.obs_sim(spark, d), ["basin"]), ["basin"])


@query("skill_by_lead", "SELECT basin, lead, count(*) AS n, round(1 - avg((sim - obs)^2) / var_pop(obs), 6) AS nse, round(sqrt(avg((sim - obs)^2)), 6) AS rmse FROM forecast WHERE obs IS NOT NULL AND sim IS NOT NULL GROUP BY GROUPING SETS ((basin, lead), (basin))", "forecast")
def skill_by_lead(spark, d):
    return _rounded(skill.skill_by_lead(base.forecast(spark, d), "basin", "lead", ["n", "nse", "rmse"]), ["basin", "lead"])


@query("skill_medians", f"""WITH t AS (SELECT basin, {_SKILL} FROM obs_sim WHERE obs IS NOT NULL AND sim IS NOT NULL GROUP BY 1)
SELECT 'nse' AS metric, round(quantile_cont(nse, 0.5), 5) AS median, count(nse) AS entities FROM t UNION ALL SELECT 'kge', round(quantile_cont(kge, 0.5), 5), count(kge) FROM t""", "obs_sim")
def skill_medians(spark, d):
    t = _rounded(skill.skill(base.obs_sim(spark, d), ["basin"], ["nse", "kge"]), ["basin"])
    return skill.medians(t, ["nse", "kge"]).select("metric", R("median", 5).alias("median"), "entities")


@query("duration_bias", """WITH v AS (SELECT basin, obs AS o, sim AS s, count(*) OVER (PARTITION BY basin) AS n, row_number() OVER (PARTITION BY basin ORDER BY obs DESC) AS ro, row_number() OVER (PARTITION BY basin ORDER BY sim DESC) AS rs FROM obs_sim WHERE obs IS NOT NULL AND sim IS NOT NULL),
r AS (SELECT *, ln(greatest(o, 1e-6)) AS lo, ln(greatest(s, 1e-6)) AS ls, round_even(0.02 * n, 0) AS top, round_even(0.7 * n, 0) AS bot, greatest(1, round_even(0.2 * n, 0)) AS ia, greatest(1, round_even(0.7 * n, 0)) AS ib FROM v),
g AS (SELECT basin, sum(s) FILTER (rs <= top) AS st, sum(o) FILTER (ro <= top) AS ot, sum(ls - 0) FILTER (rs > bot) AS sl, sum(lo) FILTER (ro > bot) AS ol, min(ls) FILTER (rs > bot) AS sm, min(lo) FILTER (ro > bot) AS om, count(*) FILTER (rs > bot) AS k,
max(lo) FILTER (ro = ia) AS oa, max(lo) FILTER (ro = ib) AS ob, max(ls) FILTER (rs = ia) AS sa, max(ls) FILTER (rs = ib) AS sb FROM r GROUP BY 1)
SELECT basin, round((st - ot) / ot * 100, 5) AS fhv, round(-100 * ((sl - k * sm) - (ol - k * om)) / ((ol - k * om) + 1e-6), 5) AS flv, round(((sa - sb) - (oa - ob)) / ((oa - ob) + 1e-6) * 100, 5) AS fms FROM g""", "obs_sim")
def duration_bias(spark, d):
    return skill.duration_bias(base.obs_sim(spark, d), "basin").select("basin", *[R(c, 5).alias(c) for c in ("fhv", "flv", "fms")])


@query("compare_series", """SELECT basin, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both_valid, count(*) FILTER (x IS NOT NULL AND y IS NULL) AS only_a, count(*) FILTER (x IS NULL AND y IS NOT NULL) AS only_b,
round(avg(x - y), 6) AS bias, round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg((x - y)^2)), 6) AS rmse, round(corr(x, y), 6) AS r, round(var_pop(x) FILTER (y IS NOT NULL) / var_pop(y) FILTER (x IS NOT NULL), 6) AS variance_ratio,
round(avg(CASE WHEN abs(x - y) <= 1e-3 THEN 1.0 WHEN x IS NOT NULL AND y IS NOT NULL THEN 0.0 END), 6) AS within_1e3
FROM (SELECT basin, date, q AS x FROM flow) a FULL JOIN (SELECT basin, date, sim AS y FROM obs_sim) b USING (basin, date) GROUP BY 1""", "flow obs_sim")
def compare_series(spark, d):
    a, b = base.flow(spark, d), base.obs_sim(spark, d).select("basin", "date", F.col("sim").alias("q"))
    out = skill.compare(a, b, ["basin", "date"], "q", ["basin"])
    return out.select("basin", "both_valid", "only_a", "only_b", *[R(c).alias(c) for c in out.columns[4:]])


@query("quantile_coverage", "SELECT basin, " + ", ".join(f"round(coalesce(avg((o BETWEEN a{i} AND b{i})::INT), 0), 6) AS within_{int(b * 100)}" for i, b in enumerate((0.9, 0.8, 0.5, 0.2, 0.1))) + " FROM (SELECT basin, date, min(obs) AS o, " + ", ".join(f"quantile_cont(sim, {round((1 - b) / 2, 4)}) AS a{i}, quantile_cont(sim, {round((1 + b) / 2, 4)}) AS b{i}" for i, b in enumerate((0.9, 0.8, 0.5, 0.2, 0.1))) + " FROM (SELECT f.basin, f.date, f.sim, q AS obs FROM forecast f JOIN flow USING (basin, date)) GROUP BY 1, 2) GROUP BY 1", "forecast flow")
def quantile_coverage(spark, d):
    f = base.forecast(spark, d).drop("obs").join(base.flow(spark, d).withColumnRenamed("q", "obs"), ["basin", "date"])
    out = skill.quantile_coverage(f, ["basin"], "obs", "sim", ["basin", "date"])
    return out.select("basin", *[R(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in out.columns[1:]])


@query("build_samples", """SELECT basin, date, list(q) OVER (PARTITION BY basin ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS x, lead(q, 1) OVER (PARTITION BY basin ORDER BY date) AS y FROM flow QUALIFY count(*) OVER (PARTITION BY basin ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7 AND y IS NOT NULL""", "flow")
def build_samples(spark, d):
    w = Window.partitionBy("basin").orderBy("date")
    s = base.flow(spark, d).select("basin", "date", F.collect_list("q").over(w.rowsBetween(-6, 0)).alias("x"), F.lead("q", 1).over(w).alias("y"))
    return s.where((F.size("x") == 7) & F.col("y").isNotNull())


@query("union_features", "SELECT basin, date, coalesce(o.sim, f.q) AS v FROM (SELECT basin, date, round(sim, 6) AS sim FROM obs_sim) o LEFT JOIN flow f USING (basin, date)", "obs_sim flow")
def union_features(spark, d):
    return base.obs_sim(spark, d).select("basin", "date", R("sim").alias("sim")).join(base.flow(spark, d), ["basin", "date"], "left").select("basin", "date", F.coalesce("sim", "q").alias("v"))


@query("reference_et", """SELECT s_suppkey, round(greatest((0.408 * d * rn + 0.0665 * 900 / (t + 273) * 2 * (0.6108 * exp(17.27 * t / (t + 237.3)) - 0.6108 * exp(17.27 * td / (td + 237.3)))) / (d + 0.0665 * (1 + 0.34 * 2)), 0), 6) AS et FROM
(SELECT *, 4098 * (0.6108 * exp(17.27 * t / (t + 237.3))) / (t + 237.3)^2 AS d FROM (SELECT s_suppkey, s_suppkey % 35 * 1.0 AS t, s_suppkey % 35 * 0.5 AS td, s_acctbal / 500 AS rn FROM supplier))""")
def reference_et(spark, d):
    k = F.col("s_suppkey") % 35
    et = weather.reference_et(F.lit(100.0), k * 1.0, k * 0.5, F.lit(2.0), F.col("s_acctbal") / 500)
    return base.read(spark, d, "supplier").select("s_suppkey", R(et).alias("et"))


@query("wind", "SELECT c_custkey, round(sqrt(u * u + v * v), 6) AS speed, round((270 - degrees(atan2(v, u)) + 720) % 360, 6) AS bearing FROM (SELECT c_custkey, c_custkey % 17 - 8.5 AS u, c_custkey % 13 - 6.25 AS v FROM customer)")
def wind(spark, d):
    u, v = F.col("c_custkey") % 17 - 8.5, F.col("c_custkey") % 13 - 6.25
    return base.read(spark, d, "customer").select("c_custkey", R(weather.wind_speed(u, v)).alias("speed"), R(weather.wind_from(u, v)).alias("bearing"))


@query("spread_confidence", """SELECT basin, date, CASE WHEN p50 IS NULL OR p50 <= 0 THEN NULL WHEN (p75 - p25) / p50 <= 0.5 THEN 'high' WHEN (p75 - p25) / p50 <= 1.0 THEN 'medium' ELSE 'low' END AS confidence FROM
(SELECT basin, date, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75 FROM ensemble WHERE value >= 0 GROUP BY 1, 2)""", "ensemble")
def spread_confidence(spark, d):
    p = zonal.member_percentiles(base.ensemble(spark, d), ["basin", "date"])
    return p.select("basin", "date", weather.spread_confidence(F.col("p50"), F.col("p25"), F.col("p75")).alias("confidence"))


@query("climate_indices", """WITH x AS (SELECT basin, date, q AS p, obs * 1.1 AS pet, month(date) - 5.0 AS temp FROM flow JOIN obs_sim USING (basin, date)), n AS (SELECT *, avg(p) OVER (PARTITION BY basin) AS pm FROM x),
m AS (SELECT basin, month(date) AS m, avg(p) AS p, avg(pet) AS e, avg(temp) AS t FROM x GROUP BY 1, 2), i AS (SELECT *, CASE WHEN p > e THEN 1 - e / p WHEN p < e THEN p / e - 1 ELSE 0 END AS i FROM m),
y AS (SELECT basin, avg(i) AS mi, max(i) - min(i) AS se, sum(CASE WHEN t <= 0 THEN p ELSE 0 END) / sum(p) AS sn FROM i GROUP BY 1),
k AS (SELECT basin, date, 'high' AS kind, p >= 5 * pm AS o FROM n UNION ALL SELECT basin, date, 'low', p < 1 FROM n),
g AS (SELECT *, row_number() OVER (PARTITION BY basin, kind ORDER BY date) - row_number() OVER (PARTITION BY basin, kind, o ORDER BY date) AS g FROM k), r AS (SELECT basin, kind, g, count(*) AS n FROM g WHERE o GROUP BY 1, 2, 3),
f AS (SELECT basin, kind, sum(n) AS s, avg(n) AS dur FROM r GROUP BY 1, 2), w AS (SELECT basin, avg(p) AS pm, avg(pet) AS em, count(p) AS days FROM x GROUP BY 1)
SELECT basin, round(pm, 4) AS p_mean, round(em, 4) AS pet_mean, round(em / pm, 4) AS aridity, round(mi, 4) AS moisture_index, round(se, 4) AS seasonality, round(sn, 4) AS frac_snow,
round(coalesce(h.s / days, 0), 4) AS high_freq, round(coalesce(h.dur, 0), 4) AS high_dur, round(coalesce(l.s / days, 0), 4) AS low_freq, round(coalesce(l.dur, 0), 4) AS low_dur
FROM w JOIN y USING (basin) LEFT JOIN (SELECT * FROM f WHERE kind = 'high') h USING (basin) LEFT JOIN (SELECT * FROM f WHERE kind = 'low') l USING (basin)""", "flow obs_sim")
def climate_indices(spark, d):
    x = base.flow(spark, d).join(base.obs_sim(spark, d), ["basin", "date"]).select("basin", "date", F.col("q").alias("p"), (F.col("obs") * 1.1).alias("pet"), (F.month("date") - 5.0).alias("temp"))
    return climate.climate_indices(x)


@query("daily_lead_mean", """WITH s AS (SELECT basin, date, lead * 12 AS h, obs AS v FROM forecast), t AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY basin, date ORDER BY h), 0) AS a FROM s),
u AS (SELECT *, h - a AS d, (a // 24 + 1)::INT AS lead_day FROM t) SELECT basin, date, lead_day, round(sum(v * d) / 24, 6) AS v FROM u GROUP BY 1, 2, 3 HAVING bool_and(ceil(h / 24) = lead_day) AND sum(d) = 24""", "forecast")
def daily_lead_mean(spark, d):
    s = base.forecast(spark, d).select("basin", "date", (F.col("lead") * 12).alias("h"), F.col("obs").alias("v"))
    return climate.daily_lead_aggregate(s, ["basin", "date"], "h", "v").withColumn("v", R("v"))
