"""Queries on planes at points, areas, live flows, lines of levels and matched networks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshet.operators import places
from freshet.plans import base
from freshet.plans.base import VIEWS, query
from freshet.plans.samples_and_models import gauges, streams

R = lambda c, n=6: F.round(c, n)

VIEWS |= {
    "planes": "SELECT week, lat_idx AS row, lon_idx AS col, CASE WHEN (lat_idx * 5 + lon_idx) % 11 > 0 THEN value END AS value FROM grid",
    "lines": """SELECT s_suppkey AS unit, s_suppkey // 2 AS below, s_acctbal + 1000 AS area, s_suppkey % 3 > 0 AS has_forecast, (s_suppkey * 53 % 1400) / 10.0::DOUBLE - 70 AS lat1, (s_suppkey * 97 % 3400) / 10.0::DOUBLE - 170 AS lon1,
        (s_suppkey * 53 % 1400) / 10.0::DOUBLE - 70 + (s_suppkey % 7 - 3) / 4.0::DOUBLE AS lat2, (s_suppkey * 97 % 3400) / 10.0::DOUBLE - 170 + (s_suppkey % 5 - 2) / 4.0::DOUBLE AS lon2 FROM supplier WHERE s_suppkey > 0""",
    "alerts": "SELECT user_id AS unit, max(event_id % 5) AS severity FROM events GROUP BY 1",
}


def planes(spark, d):
    value = F.when((F.col("lat_idx") * 5 + F.col("lon_idx")) % 11 > 0, F.col("value"))
    return base.grid(spark, d).select("week", F.col("lat_idx").alias("row"), F.col("lon_idx").alias("col"), value.alias("value"))


def lines(spark, d):
    k = F.col("s_suppkey")
    lat, lon = k * 53 % 1400 / 10.0 - 70, k * 97 % 3400 / 10.0 - 170
    vertex = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    line = F.array(vertex(lon, lat), vertex(lon + (k % 5 - 2) / 4.0, lat + (k % 7 - 3) / 4.0))
    return base.read(spark, d, "supplier").where("s_suppkey > 0").select(k.alias("unit"), F.floor(k / 2).alias("below"), (F.col("s_acctbal") + 1000).alias("area"), (k % 3 > 0).alias("has_forecast"), line.alias("line"))


def alerts(spark, d):
    return base.read(spark, d, "events").groupBy(F.col("user_id").alias("unit")).agg(F.max(F.col("event_id") % 5).alias("severity"))


@query("bilinear_samples", """WITH p AS (SELECT point_id, least(greatest((90 - lat) / 30, 0), 5) AS r, ((lon + 180) % 360) / 30 AS c FROM points),
k AS (SELECT point_id, unnest([floor(r), floor(r), least(floor(r) + 1, 5), least(floor(r) + 1, 5)])::BIGINT AS row, unnest([floor(c) % 12, (floor(c) + 1) % 12, floor(c) % 12, (floor(c) + 1) % 12])::BIGINT AS col,
unnest([(1 - (r - floor(r))) * (1 - (c - floor(c))), (1 - (r - floor(r))) * (c - floor(c)), (r - floor(r)) * (1 - (c - floor(c))), (r - floor(r)) * (c - floor(c))]) AS w FROM p)
SELECT point_id, week, round(CASE WHEN sum(w) FILTER (value IS NOT NULL) >= 0.8 - 1e-6 THEN sum(w * value) / sum(w) FILTER (value IS NOT NULL) END, 6) AS value FROM k JOIN planes USING (row, col) WHERE w > 0 GROUP BY 1, 2""", "points grid planes")
def bilinear_samples(spark, d):
    return places.bilinear_sample(base.points(spark, d), planes(spark, d), ["week"], 6, 12, 30.0).withColumn("value", R("value"))


_E = places.ECCENTRICITY
_Q = lambda s: f"((1 - {_E}^2) * ({s} / (1 - {_E}^2 * {s} * {s}) - ln((1 - {_E} * {s}) / (1 + {_E} * {s})) / (2 * {_E})))"
_H = lambda lat: f"tan(asin(greatest(-1, least(1, {_Q(f'sin(radians({lat}))')} / {_Q('1.0')}))) / 2)"


@query("geodesic_areas", f"""WITH v AS (SELECT point_id, unnest([0, 1, 2, 3]) AS i, unnest([lon - 3, lon, lon + 3, lon]) AS x, unnest([lat, lat - 2, lat, lat + 2]) AS y FROM points WHERE abs(lat) < 87),
e AS (SELECT a.point_id, radians(((b.x - a.x + 540) % 360) - 180) AS t, {_H('a.y')} AS p, {_H('b.y')} AS q FROM v a JOIN v b ON b.point_id = a.point_id AND b.i = (a.i + 1) % 4)
SELECT point_id, round(abs(sum(2 * atan(tan(t / 2) * (p + q) / (1 + p * q)))) * {places.SEMI_AXIS}^2 * {_Q('1.0')} / 2, 3) AS km2 FROM e GROUP BY 1""", "points")
def geodesic_areas(spark, d):
    """Diamonds of 6 by 4 degrees around all points that are not within 3 degrees of a pole."""
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    ring = F.array(corner(-3.0, 0.0), corner(0.0, -2.0), corner(3.0, 0.0), corner(0.0, 2.0))
    return base.points(spark, d).where("abs(lat) < 87").select("point_id", R(places.geodesic_area_km2(ring), 3).alias("km2"))


@query("live_flows", """WITH f AS (SELECT s_suppkey, s_acctbal / 5 AS q, CASE WHEN s_suppkey % 9 > 0 THEN (s_suppkey % 40 * 25)::DOUBLE ELSE 0 END AS a, (s_suppkey % 17 * 100)::DOUBLE AS b, (s_suppkey % 29 * 100)::DOUBLE AS c, (s_suppkey % 31 * 150)::DOUBLE AS d, s_suppkey % 6 // 4 AS m FROM supplier),
t AS (SELECT s_suppkey, greatest(q, 0) AS q, a AS q2, CASE WHEN b > a THEN b ELSE 1.66 * a END AS q5, c, d, m, a FROM f), u AS (SELECT *, CASE WHEN c > q5 THEN c ELSE 2.5 * a END AS q20 FROM t), v AS (SELECT *, CASE WHEN d > q20 THEN d ELSE 0 END AS q50 FROM u),
k AS (SELECT *, greatest(m, CASE WHEN q50 > 0 AND q >= q50 THEN 4 WHEN q20 > 0 AND q >= q20 THEN 3 WHEN q5 > 0 AND q >= q5 THEN 2 WHEN q2 > 0 AND q >= q2 THEN 1 ELSE 0 END) AS rank, q / nullif(q2, 0) AS r, greatest(1.05, q5 / nullif(q2, 0)) AS r5 FROM v),
n AS (SELECT *, greatest(r5 + 0.1, q20 / nullif(q2, 0)) AS r20 FROM k),
p AS (SELECT *, CASE WHEN q2 <= 0 THEN CASE WHEN q > 0 THEN 50 ELSE 5 END WHEN r <= 0.12 THEN 2 + r / 0.12 * 23 WHEN r <= 0.32 THEN 25 + (r - 0.12) / 0.2 * 25 WHEN r <= 0.65 THEN 50 + (r - 0.32) / 0.33 * 25 WHEN r <= 0.85 THEN 75 + (r - 0.65) / 0.2 * 9
WHEN r <= 1 THEN 84 + (r - 0.85) / 0.15 * 6 WHEN r <= r5 THEN 90 + (r - 1) / (r5 - 1) * 5 WHEN r <= r20 THEN 95 + (r - r5) / (r20 - r5) * 4 WHEN r <= r20 * 1.5 THEN 99 + (r - r20) / (r20 * 0.5) * 0.9 ELSE 99.9 END AS pct FROM n)
SELECT s_suppkey, round(round_even(least(greatest(pct, CASE rank WHEN 1 THEN 91 WHEN 2 THEN 96 WHEN 3 THEN 99.3 WHEN 4 THEN 99.8 ELSE 1 END), 99.9), 1), 0) AS percentile, rank FROM p""")
def live_flows(spark, d):
    """Percentiles to whole numbers, as halves of a digit fall on either side."""
    k = F.col("s_suppkey")
    n = lambda m, f: (k % m * f).cast("double")
    m = places.live_flow_metrics(F.col("s_acctbal") / 5, F.when(k % 9 > 0, n(40, 25)).otherwise(0.0), n(17, 100), n(29, 100), n(31, 150), F.floor(k % 6 / 4))
    return base.read(spark, d, "supplier").select("s_suppkey", m.alias("m")).select("s_suppkey", F.round("m.percentile", 0).alias("percentile"), "m.rank")


_ALIASES = [("era5_land", "ERA5_LAND"), ("era5", "ERA5"), ("chirps_gefs", "CHIRPS_GEFS"), ("chirps", "CHIRPS"), ("imerg", "IMERG")]


@query("feature_products", f"""WITH f AS (SELECT event_id, (['era5_land_temp', 'ERA5-precip', 'chirps_gefs_land_precip', 'chirps_x', 'hres_t2m', 'imergx_p', 'imerg', 'era5_landx_t'])[event_id % 8 + 1] AS feature FROM events),
a AS (SELECT unnest({[a for a, _ in _ALIASES]}) AS alias, unnest({[p for _, p in _ALIASES]}) AS product),
t AS (SELECT event_id, feature, string_split(replace(lower(feature), '-', '_'), '_') AS t FROM f), k AS (SELECT event_id, unnest(range(1, len(t))) AS k, t FROM t),
b AS (SELECT event_id, max_by(product, k) AS product FROM k JOIN a ON alias = array_to_string(t[1:k], '_') GROUP BY 1)
SELECT event_id, feature, coalesce(product, upper(string_split(feature, '_')[1])) AS product FROM f LEFT JOIN b USING (event_id)""")
def feature_products(spark, d):
    names = ["era5_land_temp", "ERA5-precip", "chirps_gefs_land_precip", "chirps_x", "hres_t2m", "imergx_p", "imerg", "era5_landx_t"]
    f = base.read(spark, d, "events").select("event_id", F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 8).cast("int")).alias("feature"))
    return places.product_of_feature(f, "feature", spark.createDataFrame(_ALIASES, "alias string, product string"))


@query("ldd_graph", """WITH c AS (SELECT p_partkey // 64 AS row, p_partkey % 64 AS col, p_partkey * 7 % 10 AS code, p_size AS area FROM part WHERE p_size >= 10),
l AS (SELECT *, row + CASE WHEN code IN (1, 2, 3) THEN 1 WHEN code IN (7, 8, 9) THEN -1 WHEN code IN (4, 6) THEN 0 END AS r, col + CASE WHEN code IN (1, 4, 7) THEN -1 WHEN code IN (3, 6, 9) THEN 1 WHEN code IN (2, 8) THEN 0 END AS k FROM c)
SELECT l.row, l.col, l.area, c.row AS down_row, c.col AS down_col FROM l LEFT JOIN c ON c.row = l.r AND c.col = l.k""")
def ldd_graph(spark, d):
    k = F.col("p_partkey")
    cells = base.read(spark, d, "part").select(F.floor(k / 64).alias("row"), (k % 64).alias("col"), (k * 7 % 10).alias("code"), F.col("p_size").alias("area"))
    return places.ldd_graph(cells, 10)


@query("oriented_lines", """WITH g AS (SELECT a.unit, a.lon1, a.lat1, a.lon2, a.lat2, least(sqrt((a.lon1 - b.lon1) ^ 2 + (a.lat1 - b.lat1) ^ 2), sqrt((a.lon1 - b.lon2) ^ 2 + (a.lat1 - b.lat2) ^ 2)) AS first, least(sqrt((a.lon2 - b.lon1) ^ 2 + (a.lat2 - b.lat1) ^ 2), sqrt((a.lon2 - b.lon2) ^ 2 + (a.lat2 - b.lat2) ^ 2)) AS last FROM lines a LEFT JOIN lines b ON b.unit = a.below)
SELECT unit, CASE WHEN first + 1e-9 < last THEN lon2 ELSE lon1 END AS from_lon, CASE WHEN first + 1e-9 < last THEN lat2 ELSE lat1 END AS from_lat FROM g""", "lines")
def oriented_lines(spark, d):
    out = places.orient_reaches(lines(spark, d), "unit", "below", "line")
    return out.select("unit", F.element_at("line", 1)["lon"].alias("from_lon"), F.element_at("line", 1)["lat"].alias("from_lat"))


@query("level_lines", """SELECT unit, round(area, 1) AS area, CASE WHEN has_forecast THEN coalesce(severity, 0) ELSE 0 END AS severity, round(lon1, 4) AS from_lon FROM lines LEFT JOIN alerts USING (unit)
WHERE greatest(lon1, lon2) >= -100 AND least(lon1, lon2) <= 80 AND greatest(lat1, lat2) >= -40 AND least(lat1, lat2) <= 50""", "lines alerts")
def level_lines(spark, d):
    out = places.level_features(lines(spark, d), -100.0, -40.0, 80.0, 50.0, alerts(spark, d), "unit")
    return out.select("unit", F.round("area", 1).alias("area"), "severity", F.element_at("line", 1)["lon"].alias("from_lon"))


@query("promoted_lines", """WITH c AS (SELECT *, floor(lon2 / 10) AS x, floor(lat2 / 10) AS y FROM lines WHERE area >= 6000), n AS (SELECT *, floor(lon2 / 10) AS x, floor(lat2 / 10) AS y FROM lines WHERE unit IN (SELECT unit FROM alerts WHERE severity >= 1) AND unit NOT IN (SELECT unit FROM c)),
p AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.x = n.x AND c.y = n.y) QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY area DESC, unit) = 1)
SELECT unit, area, false AS promoted FROM c UNION ALL SELECT unit, area, true FROM p""", "lines alerts")
def promoted_lines(spark, d):
    fine = lines(spark, d)
    return places.promote_active(fine.where("area >= 6000"), fine, alerts(spark, d).where("severity >= 1"), "unit", 10.0).select("unit", "area", "promoted")


@query("top_points", """WITH i AS (SELECT point_id, target_area AS area, CASE WHEN point_id % 4 > 0 THEN point_id % 97 END AS unit, point_id % 3 > 0 AS has_forecast FROM gauges WHERE lon BETWEEN -150 AND 140 AND lat BETWEEN -60 AND 60 AND target_area >= 500)
SELECT point_id, area FROM (SELECT * FROM i QUALIFY unit IS NULL OR row_number() OVER (PARTITION BY unit ORDER BY has_forecast DESC, area DESC, point_id) = 1) ORDER BY area DESC, point_id LIMIT 40""", "gauges")
def top_points(spark, d):
    k = F.col("point_id")
    p = gauges(spark, d).withColumnRenamed("target_area", "area").withColumns({"unit": F.when(k % 4 > 0, k % 97), "has_forecast": k % 3 > 0})
    return places.top_points(p, -150.0, -60.0, 140.0, 60.0, 500.0, "unit", 40).select("point_id", "area")


@query("matched_networks")
def matched_networks(spark, d):
    """Gauges on one network, then its area and place on a second of the same rivers set off by a tenth of a degree."""
    first = streams(spark, d)
    second = first.select(F.col("reach_id") + 100_000, *[(F.col(c) + 0.1).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")], (F.col("area") * 1.2).alias("area")).toDF("reach_id", "lat1", "lon1", "lat2", "lon2", "area")
    out = places.cross_network_match(gauges(spark, d), {"first": first, "second": second}, ["first", "second"], 60.0, 200.0, 50.0, 8.0, 0.3)
    return out.select("point_id", "target_area", "first.reach_id", F.col("second.reach_id").alias("second_id"), R("second.area", 4).alias("second_area"))
