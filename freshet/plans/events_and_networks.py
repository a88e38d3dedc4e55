"""Queries on flood frequency, event scores, river networks and provider payloads."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.functions import mixture
from freshet.operators import frame, frequency, network, peaks
from freshet.plans import base
from freshet.plans.base import query

R = lambda c, n=6: F.round(c, n)
#: The tables span seven years with few days each, hence the wide limits.
MAX_MISSING, MIN_YEARS = 320, 5
PERIODS = [2.0, 5.0, 10.0, 20.0, 50.0, 100.0]
_ANNUAL = f"(SELECT basin, year(date) AS year, count(*) AS days, max(q) AS peak FROM flow WHERE q >= 0 GROUP BY 1, 2 HAVING count(*) >= {365 - MAX_MISSING})"
_K = lambda t: f"(-sqrt(6) / pi() * ({frequency.EULER} + ln(ln({t} / ({t} - 1)))))"
_FIT = f"(SELECT basin, count(peak) AS years, avg(peak) AS mean, stddev_samp(peak) AS std FROM {_ANNUAL} GROUP BY 1 HAVING count(peak) >= {MIN_YEARS} AND avg(peak) > 1e-3)"
_LEVEL = lambda t: f"greatest(0, mean + {_K(float(t))} * std)"


def _annual(spark, d):
    return frequency.annual_maxima(base.flow(spark, d), "basin", "date", "q", MAX_MISSING)


def _levels(spark, d, periods=PERIODS):
    return frequency.gumbel_flows(frequency.fit_gumbel(_annual(spark, d), "basin", "peak", MIN_YEARS), "basin", periods)


@query("annual_maxima", f"SELECT basin, year, days, peak FROM {_ANNUAL}", "flow")
def annual_maxima(spark, d):
    return _annual(spark, d)


@query("sample_moments", f"""WITH a AS {_ANNUAL}, x AS (SELECT basin, log10(peak) AS v, log10(peak) - avg(log10(peak)) OVER (PARTITION BY basin) AS dv FROM a WHERE peak > 0)
SELECT basin, count(*) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS std, round(CASE WHEN count(*) >= 3 AND stddev_samp(v) > 0 THEN count(*) / ((count(*) - 1) * (count(*) - 2)) * sum(dv^3) / stddev_samp(v)^3 END, 6) AS skew FROM x GROUP BY 1""", "flow")
def sample_moments(spark, d):
    m = frequency.sample_moments(_annual(spark, d).where("peak > 0"), ["basin"], F.log10("peak"))
    return m.select("basin", "n", R("mean", 8).alias("mean"), R("std", 8).alias("std"), R("skew").alias("skew"))


@query("gumbel_flows", f"SELECT basin, t AS period, round(greatest(0, mean + {_K('t')} * std), 6) AS flow FROM {_FIT}, (SELECT unnest([2.0, 5.0, 10.0, 20.0, 50.0, 100.0])::DOUBLE AS t)", "flow")
def gumbel_flows(spark, d):
    return _levels(spark, d).select("basin", "period", R("flow").alias("flow"))


@query("flood_thresholds", f"""WITH fit AS {_FIT}, a AS {_ANNUAL}, last AS (SELECT basin, year, peak FROM a QUALIFY row_number() OVER (PARTITION BY basin ORDER BY year DESC) = 1)
SELECT basin, year, peak, {', '.join(f'round({_LEVEL(t)}, 6) AS rp{int(t)}' for t in PERIODS)},
CASE WHEN peak >= {_LEVEL(100)} THEN 4 WHEN peak >= {_LEVEL(20)} THEN 3 WHEN peak >= {_LEVEL(5)} THEN 2 WHEN peak >= {_LEVEL(2)} THEN 1 ELSE 0 END AS class FROM last JOIN fit USING (basin)""", "flow")
def flood_thresholds(spark, d):
    peaks = _annual(spark, d)
    wide = frequency.gumbel_flows(frequency.fit_gumbel(peaks, "basin", "peak", MIN_YEARS), "basin", PERIODS).groupBy("basin").pivot("period", PERIODS).agg(F.first("flow"))
    levels = wide.select("basin", *[F.col(f"`{t}`").alias(f"rp{int(t)}") for t in PERIODS])
    last = peaks.groupBy("basin").agg(F.max_by(F.struct("year", "peak"), "year").alias("l")).select("basin", "l.year", "l.peak")
    rank = frequency.classify_exceedance(F.col("peak"), {t: F.col(f"rp{t}") for t in (2, 5, 20, 100)})
    return last.join(levels, "basin").select("basin", "year", "peak", *[R(f"rp{int(t)}").alias(f"rp{int(t)}") for t in PERIODS], rank.alias("class"))


@query("ev1_line", f"""WITH l AS (SELECT basin, {_K('t')} AS k, round(greatest(0, mean + {_K('t')} * std), 3) AS flow FROM {_FIT}, (SELECT unnest([2.0, 5.0, 20.0, 100.0])::DOUBLE AS t))
SELECT basin, round(regr_slope(flow, k), 5) AS slope, round(regr_intercept(flow, k), 5) AS intercept FROM l GROUP BY 1""", "flow")
def ev1_line(spark, d):
    levels = _levels(spark, d, [2.0, 5.0, 20.0, 100.0]).withColumn("flow", R("flow", 3))
    return frequency.ev1_line(levels, "basin").select("basin", R("slope", 5).alias("slope"), R("intercept", 5).alias("intercept"))


@query("index_flood", f"SELECT s_suppkey, round((s_acctbal + 1000) * 3.3 * (1 + {_K('20.0')} * 0.45), 5) AS flow20 FROM supplier")
def index_flood(spark, d):
    return base.read(spark, d, "supplier").select("s_suppkey", R(frequency.index_flood(F.col("s_acctbal") + 1000, F.lit(20.0)), 5).alias("flow20"))


@query("plotting_positions", f"SELECT basin, year, peak, row_number() OVER w AS rank, round((row_number() OVER w - 0.4) / (count(*) OVER (PARTITION BY basin) + 0.2), 8) AS exceedance FROM {_ANNUAL} WINDOW w AS (PARTITION BY basin ORDER BY peak DESC, year)", "flow")
def plotting_positions(spark, d):
    return frequency.plotting_positions(_annual(spark, d), "basin", "peak").select("basin", "year", "peak", "rank", R("exceedance", 8).alias("exceedance"))


@query("loglog_fit", f"""WITH p AS (SELECT basin, log10(peak) AS x, log10(-log10(row_number() OVER (PARTITION BY basin ORDER BY peak DESC, year) / (count(*) OVER (PARTITION BY basin) + 1))) AS y FROM {_ANNUAL} WHERE peak > 0)
SELECT basin, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM p GROUP BY 1""", "flow")
def loglog_fit(spark, d):
    return frequency.fit_loglog(_annual(spark, d), "basin", "peak").select("basin", R("slope", 5).alias("slope"), R("intercept", 5).alias("intercept"))


@query("empirical_pdf", """WITH w AS (SELECT basin, q, min(q) OVER (PARTITION BY basin) AS a, max(q) OVER (PARTITION BY basin) AS b, count(*) OVER (PARTITION BY basin) AS n FROM flow)
SELECT basin, CASE WHEN b > a THEN least(4, floor((q - a) / (b - a) * 5)) ELSE 0 END::INT AS bin, round(count(*) / min(n), 8) AS share FROM w GROUP BY 1, 2""", "flow")
def empirical_pdf(spark, d):
    return frequency.empirical_pdf(base.flow(spark, d), "basin", "q").withColumn("share", R("share", 8))


def _scored(spark, d):
    limits = base.flow(spark, d).groupBy("basin").agg((F.avg("q") * 1.5).alias("limit"))
    f = base.obs_sim(spark, d).join(limits, "basin")
    return frequency.flood_event_scores(f.withColumnRenamed("limit", "lo").withColumn("ls", F.col("lo")), "basin", "date", 2, "lo", "ls")


@query("flood_event_scores", """WITH t AS (SELECT basin, avg(q) * 1.5 AS l FROM flow GROUP BY 1),
m AS (SELECT basin, date, coalesce(obs >= l AND (row_number() OVER w = 1 OR lag(obs) OVER w < l), false) AS o, coalesce(sim >= l AND (row_number() OVER w = 1 OR lag(sim) OVER w < l), false) AS s,
CASE WHEN count(obs) OVER v = count(*) OVER v THEN (max(obs) OVER v >= l)::INT END AS ho, CASE WHEN count(sim) OVER v > 0 THEN (max(sim) OVER v >= l)::INT END AS hs
FROM obs_sim JOIN t USING (basin) WINDOW w AS (PARTITION BY basin ORDER BY date), v AS (PARTITION BY basin ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
g AS (SELECT basin, count(*) FILTER (o) AS n_obs, count(*) FILTER (s) AS n_sim, avg(ho) FILTER (s) AS p, avg(hs) FILTER (o) AS r FROM m GROUP BY 1)
SELECT basin, n_obs, n_sim, round(p, 8) AS precision, round(r, 8) AS recall, round(CASE WHEN p IS NULL AND r IS NULL THEN NULL WHEN coalesce(p, 0) + coalesce(r, 0) = 0 OR p IS NULL OR r IS NULL THEN 0 ELSE 2 * p * r / (p + r) END, 8) AS f1 FROM g""", "flow obs_sim")
def flood_event_scores(spark, d):
    return _scored(spark, d).select("basin", "n_obs", "n_sim", *[R(c, 8).alias(c) for c in ("precision", "recall", "f1")])


def _between(a: int, b: int) -> str:
    k = f"({_K(a)} + (peak - f{a}) / (f{b} - f{a}) * ({_K(b)} - {_K(a)}))"
    return f"least(1000, greatest(1, 1 / (1 - exp(-exp(-pi() / sqrt(6) * {k} - {frequency.EULER})))))"


@query("return_period_estimate", f"""WITH l AS (SELECT basin, year, peak, {', '.join(f"{_LEVEL(t)} AS f{t}" for t in (2, 5, 20, 100))} FROM {_ANNUAL} JOIN {_FIT} USING (basin))
SELECT basin, year, peak, round(CASE WHEN NOT (f2 < f5) OR peak < f2 THEN NULL WHEN peak < f5 THEN {_between(2, 5)} WHEN peak < f20 THEN {_between(5, 20)} ELSE {_between(20, 100)} END, 6) AS period FROM l""", "flow")
def return_period_estimate(spark, d):
    wide = _levels(spark, d, [2.0, 5.0, 20.0, 100.0]).groupBy("basin").pivot("period", [2.0, 5.0, 20.0, 100.0]).agg(F.first("flow"))
    levels = [(t, F.col(f"`{t}`")) for t in (2.0, 5.0, 20.0, 100.0)]
    return _annual(spark, d).join(wide, "basin").select("basin", "year", "peak", R(frequency.return_period_estimate(F.col("peak"), levels)).alias("period"))


@query("lp3_flows", None)
def lp3_flows(spark, d):
    return frequency.lp3_flows(frequency.fit_lp3(_annual(spark, d), "basin", "peak"), "basin", PERIODS)


@query("peaks_over_threshold", """WITH RECURSIVE r AS (SELECT basin, date, q, row_number() OVER (PARTITION BY basin ORDER BY date) AS i FROM flow), l AS (SELECT basin, quantile_cont(q, 0.999) AS t FROM flow GROUP BY 1),
c AS (SELECT basin, date, q, i, row_number() OVER (PARTITION BY basin ORDER BY q DESC, i) AS k FROM r JOIN l USING (basin) WHERE q > t),
p AS (SELECT basin, 1::BIGINT AS k, [i] AS taken FROM c WHERE k = 1 UNION ALL SELECT c.basin, c.k, CASE WHEN len(list_filter(taken, lambda x: abs(x - c.i) <= 7)) = 0 THEN list_append(taken, c.i) ELSE taken END FROM p JOIN c ON c.basin = p.basin AND c.k = p.k + 1),
f AS (SELECT basin, taken FROM p QUALIFY row_number() OVER (PARTITION BY basin ORDER BY k DESC) = 1), u AS (SELECT basin, unnest(taken) AS i, generate_subscripts(taken, 1)::INT AS rank FROM f)
SELECT basin, date, q AS peak, rank FROM u JOIN r USING (basin, i)""", "flow")
def peaks_over_threshold(spark, d):
    return frequency.peaks_over_threshold(base.flow(spark, d), "basin", "date", "q", 7, 0.999)


@query("upstream_closure", """WITH RECURSIVE e AS MATERIALIZED (SELECT reach_id, next_down FROM reaches), c AS (SELECT reach_id AS start, reach_id AS member, 0 AS hops FROM e UNION ALL SELECT c.start, e.reach_id, c.hops + 1 FROM c JOIN e ON e.next_down = c.member) SELECT start, member, hops FROM c""", "reaches")
def upstream_closure(spark, d):
    return network.upstream_closure(base.reaches(spark, d), "reach_id", "next_down")


@query("contributing_area", """WITH RECURSIVE e AS MATERIALIZED (SELECT reach_id, next_down, area FROM reaches), c AS (SELECT reach_id AS start, reach_id AS member, 0 AS hops FROM e UNION ALL SELECT c.start, e.reach_id, c.hops + 1 FROM c JOIN e ON e.next_down = c.member)
SELECT start, count(*) AS units, round(sum(area), 4) AS area, max(hops) AS depth FROM c JOIN e ON e.reach_id = c.member GROUP BY 1""", "reaches")
def contributing_area(spark, d):
    r = base.reaches(spark, d)
    return network.contributing(r, "reach_id", "next_down", "area").withColumn("area", R("area", 4))


@query("main_stem", "SELECT next_down AS node, arg_max(reach_id, area) AS up, count(*) AS tributaries FROM reaches WHERE next_down <> 0 GROUP BY 1", "reaches")
def main_stem(spark, d):
    return network.main_stem(base.reaches(spark, d), "reach_id", "next_down", "area")


@query("chain_heads", "SELECT reach_id, coalesce(ups, 0) AS ups FROM reaches LEFT JOIN (SELECT next_down AS reach_id, count(*) AS ups FROM reaches GROUP BY 1) USING (reach_id) WHERE coalesce(ups, 0) <> 1", "reaches")
def chain_heads(spark, d):
    return network.chain_heads(base.reaches(spark, d), "reach_id", "next_down")


_HAV = "2 * 6371.0088 * asin(least(1.0, sqrt(sin(radians(g.lat - p.lat) / 2)^2 + cos(radians(p.lat)) * cos(radians(g.lat)) * sin(radians(g.lon - p.lon) / 2)^2)))"


@query("nearest_gauge", f"SELECT point_id, arg_min(gauge_id, (km, gauge_id)) AS gauge_id, min(km) AS km FROM (SELECT p.point_id, g.gauge_id, round({_HAV}, 9) AS km FROM points p, (SELECT s_suppkey AS gauge_id, (s_suppkey * 53 % 1700) / 10.0::DOUBLE - 85 AS lat, (s_suppkey * 71 % 3600) / 10.0::DOUBLE - 180 AS lon FROM supplier) g WHERE {_HAV} <= 900) GROUP BY 1", "points")
def nearest_gauge(spark, d):
    k = F.col("s_suppkey")
    gauges = base.read(spark, d, "supplier").select(k.alias("gauge_id"), (k * 53 % 1700 / 10.0 - 85).alias("g_lat"), (k * 71 % 3600 / 10.0 - 180).alias("g_lon"))
    return network.nearest(base.points(spark, d), gauges, 900.0)


@query("row_spans", "SELECT basin, lat_idx AS row, min(lon_idx) AS first, max(lon_idx) AS last FROM (SELECT basin, lat_idx, lon_idx, lon_idx - row_number() OVER (PARTITION BY basin, lat_idx ORDER BY lon_idx) AS g FROM weights) GROUP BY basin, lat_idx, g", "weights")
def row_spans(spark, d):
    w = base.weights(spark, d).select("basin", F.col("lat_idx").alias("row"), F.col("lon_idx").alias("col"))
    return network.row_spans(w)


@query("provider_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def provider_json(spark, d):
    return base.read(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k")).where("k IS NOT NULL")


@query("unpivot_leads", "SELECT basin, date, lead, sum(obs) AS value FROM forecast GROUP BY ALL", "forecast")
def unpivot_leads(spark, d):
    wide = base.forecast(spark, d).groupBy("basin", "date").pivot("lead", list(range(1, 8))).agg(F.sum("obs"))
    wide = wide.select("basin", "date", *[F.col(f"`{k}`").alias(f"lead_{k}") for k in range(1, 8)])
    long = wide.unpivot(["basin", "date"], [f"lead_{k}" for k in range(1, 8)], "name", "value").where("value IS NOT NULL")
    return long.select("basin", "date", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("lead"), "value")


@query("consensus", f"""WITH fit AS {_FIT}, p AS (SELECT basin, lead, max(sim) AS peak FROM forecast WHERE sim IS NOT NULL GROUP BY 1, 2), c AS (SELECT basin, lead, peak,
CASE WHEN peak >= {_LEVEL(100)} THEN 4 WHEN peak >= {_LEVEL(20)} THEN 3 WHEN peak >= {_LEVEL(5)} THEN 2 WHEN peak >= {_LEVEL(2)} THEN 1 ELSE 0 END AS rank FROM p JOIN fit USING (basin))
SELECT basin, count(*) AS models, count(*) FILTER (rank >= 1) AS alerting, max(rank) AS risk, max(peak) FILTER (true) AS peak_max FROM (SELECT basin, lead, round(peak, 6) AS peak, rank FROM c) GROUP BY 1""", "flow forecast")
def consensus(spark, d):
    levels = _levels(spark, d, [2.0, 5.0, 20.0, 100.0]).groupBy("basin").pivot("period", [2.0, 5.0, 20.0, 100.0]).agg(F.first("flow"))
    peaks = base.forecast(spark, d).where("sim IS NOT NULL").groupBy("basin", "lead").agg(F.max("sim").alias("peak"))
    ranked = peaks.join(levels, "basin").withColumn("rank", frequency.classify_exceedance(F.col("peak"), {t: F.col(f"`{float(t)}`") for t in (2, 5, 20, 100)}))
    return ranked.groupBy("basin").agg(F.count(F.lit(1)).alias("models"), F.count_if(F.col("rank") >= 1).alias("alerting"), F.max("rank").alias("risk"), F.max(R("peak")).alias("peak_max"))


@query("three_hour_bins", "SELECT event_type, strftime(time_bucket(INTERVAL 3 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def three_hour_bins(spark, d):
    return base.read(spark, d, "events").groupBy("event_type", F.date_format(F.window("ts", "3 hours")["start"], "yyyy-MM-dd HH:mm:ss").alias("start")).agg(F.count(F.lit(1)).alias("n"), R(F.avg("value")).alias("mean"))


@query("residual_nudge", """WITH b AS (SELECT *, max(CASE WHEN sim IS NOT NULL THEN date END) OVER (PARTITION BY basin) AS a FROM obs_sim),
m AS (SELECT basin, avg(obs - sim) AS r FROM b WHERE sim IS NOT NULL AND date > a - 30 GROUP BY 1)
SELECT basin, k, round(greatest(100 + 0.8 * r * power(0.9, k), 0), 6) AS nudged FROM m, (SELECT unnest(range(1, 8)) AS k)""", "obs_sim")
def residual_nudge(spark, d):
    w = Window.partitionBy("basin")
    b = base.obs_sim(spark, d).withColumn("anchor", F.max(F.when(F.col("sim").isNotNull(), F.col("date"))).over(w))
    m = b.where(F.col("sim").isNotNull() & (F.col("date") > F.date_sub("anchor", 30))).groupBy("basin").agg(F.avg(F.col("obs") - F.col("sim")).alias("r"))
    ahead = m.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("k", F.col("k").cast("bigint"))
    return ahead.select("basin", "k", R(frame.at_least(100 + 0.8 * F.col("r") * F.pow(F.lit(0.9), F.col("k")), 0.0)).alias("nudged"))


@query("peak_metrics")
def peak_metrics(spark, d):
    return peaks.peak_metrics(base.obs_sim(spark, d), "basin", "date")


@query("mixture_summary", """SELECT s_suppkey, round(0.7 * (mu + 2.0 * (1 - 2 * 0.3) / (0.3 * 0.7)) + 0.3 * (mu + 5 + 1.0 * (1 - 2 * 0.6) / (0.6 * 0.4)), 6) AS mean FROM (SELECT s_suppkey, s_suppkey % 50 * 1.0 AS mu FROM supplier)""")
def mixture_mean(spark, d):
    return _mixtures(spark, d).select("s_suppkey", R(mixture.mixture_mean(F.col("c"))).alias("mean"))


@query("mixture_quantiles")
def mixture_quantiles(spark, d):
    return _mixtures(spark, d).select("s_suppkey", *[R(mixture.mixture_quantile(F.col("c"), q / 10)).alias(f"q{q}0") for q in range(1, 10)])


def _mixtures(spark, d):
    mu = F.col("s_suppkey") % 50 * 1.0
    part = lambda m, b, tau, pi: F.struct(m.alias("mu"), F.lit(b).alias("b"), F.lit(tau).alias("tau"), F.lit(pi).alias("pi"))
    return base.read(spark, d, "supplier").select("s_suppkey", F.array(part(mu, 2.0, 0.3, 0.7), part(mu + 5, 1.0, 0.6, 0.3)).alias("c"))


@query("cell_weights", """WITH b AS (SELECT point_id AS basin, greatest(lat - 2, -90) AS s, least(lat + 2, 90) AS n, lon - 3.5 AS w, lon + 3.5 AS e FROM points),
c AS (SELECT basin, i, ((j + 72) % 72) AS j, greatest(0, least(n, i * 5 - 85) - greatest(s, i * 5 - 90)) * greatest(0, least(e, j * 5 - 175) - greatest(w, j * 5 - 180)) * cos(radians(i * 5 - 87.5)) AS a FROM b, range(36) r(i), range(-2, 75) t(j)),
g AS (SELECT basin, i, j, sum(a) AS a FROM c GROUP BY 1, 2, 3)
SELECT basin, i::INT AS lat_idx, j::INT AS lon_idx, round(a / sum(a) OVER (PARTITION BY basin), 9) AS weight FROM g WHERE a > 1e-12""", "points")
def cell_weights(spark, d):
    """Boxes of 7 by 4 degrees around all points, cut at the poles, on a grid of 5 degrees."""
    p = base.points(spark, d)
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), F.least(F.lit(90.0), F.greatest(F.lit(-90.0), F.col("lat") + y)).alias("lat"))
    rings = p.select(F.col("point_id").alias("basin"), F.lit(False).alias("is_hole"), F.array(corner(-3.5, -2.0), corner(3.5, -2.0), corner(3.5, 2.0), corner(-3.5, 2.0)).alias("pts"))
    return peaks.cell_weights(rings, 5.0).withColumn("weight", R("weight", 9))
