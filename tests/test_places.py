"""Planes at points, areas, live flows, levels and matched networks on rows with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from freshet.operators import places


def test_bilinear_corners(spark):
    plane = spark.createDataFrame([("p", r, c, None if (r, c) == (2, 3) else float(10 * r + c)) for r in range(19) for c in range(36)], "k string, row long, col long, value double")
    pts = [("node", 70.0, -150.0), ("mid", 75.0, -175.0), ("masked", 72.0, -151.0), ("near", 80.5, -150.0), ("wrap", 85.0, 175.0), ("pole", -90.0, 0.0), ("east", 90.0, 355.0), ("bad", 91.0, 0.0)]
    df = spark.createDataFrame(pts, "point_id string, lat double, lon double")
    got = {r.point_id: r.value for r in places.bilinear_sample(df, plane, ["k"], 19, 36, 10.0).collect()}
    assert got["node"] is None and got["masked"] is None and got["mid"] == pytest.approx((10 + 11 + 20 + 21) / 4)
    assert got["near"] == pytest.approx(0.05 * 3 + 0.95 * 13) and got["pole"] == pytest.approx(198.0) and "bad" not in got
    assert got["wrap"] == pytest.approx((35 + 0 + 45 + 10) / 4) and got["east"] == pytest.approx((17 + 18) / 2)


def test_areas_of_known_shapes(spark):
    ring = lambda pts: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in pts])
    dense = [(i / 50, 60.0) for i in range(51)] + [(1 - i / 50, 61.0) for i in range(51)]
    q = lambda lat: (lambda s, e=places.ECCENTRICITY: (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e)))(math.sin(math.radians(lat)))
    cell = places.SEMI_AXIS**2 / 2 * math.radians(1) * (q(61) - q(60))  # a cell of parallels and meridians
    shapes = {"equator": [(0, 0), (1, 0), (1, 1), (0, 1)], "back": [(0, 1), (1, 1), (1, 0), (0, 0)], "dense": dense, "dateline": [(179.5, 0), (-179.5, 0), (-179.5, 1), (179.5, 1)], "two": [(0, 0), (1, 1)], "octant": [(0, 0), (90, 0), (0, 90)]}
    r = spark.range(1).select(*[places.geodesic_area_km2(ring(v)).alias(k) for k, v in shapes.items()]).first()
    assert r.equator == pytest.approx(12308.8, rel=1e-3) and r.back == r.equator and r.dateline == pytest.approx(r.equator, rel=1e-9)
    assert r.dense == pytest.approx(cell, rel=1e-4) and r.two == 0.0 and r.octant == pytest.approx(510065621.7 / 8, rel=1e-6)


@pytest.mark.parametrize("flow,two,five,twenty,fifty,least,wanted", [
    (0.0, 100.0, 166.0, 250.0, 0.0, 0, (2.0, 0)), (100.0, 100.0, 166.0, 250.0, 0.0, 0, (91.0, 1)), (50.0, 0.0, 0.0, 0.0, 0.0, 0, (50.0, 0)), (0.0, 0.0, 0.0, 0.0, 0.0, 0, (5.0, 0)), (0.0, 0.0, 0.0, 0.0, 0.0, 3, (99.3, 3)),
    (1e6, 100.0, 150.0, 200.0, 300.0, 0, (99.9, 4)), (float("nan"), 100.0, 0.0, 0.0, 0.0, 0, (2.0, 0)), (170.0, 100.0, 0.0, 0.0, 0.0, 0, (96.0, 2)), (32.0, 100.0, 150.0, 200.0, 0.0, 0, (50.0, 0)), (None, None, None, None, None, None, (5.0, 0)),
])
def test_live_flows(spark, flow, two, five, twenty, fifty, least, wanted):
    df = spark.createDataFrame([(flow, two, five, twenty, fifty, least)], "f double, a double, b double, c double, d double, m int")
    r = df.select(places.live_flow_metrics(*[F.col(c) for c in "fabcdm"]).alias("x")).first().x
    assert (r.percentile, r["rank"]) == wanted


def test_products_of_features(spark):
    aliases = spark.createDataFrame([("era5_land", "ERA5_LAND"), ("era5", "ERA5")], "alias string, product string")
    f = spark.createDataFrame([("era5_land_temp",), ("era5_t",), ("era5",), ("era5_landx_t",), ("x_y",), ("era5_land_temp",)], "f string")
    got = sorted((r.f, r["product"]) for r in places.product_of_feature(f, "f", aliases).collect())
    assert got == [("era5", "ERA5"), ("era5_land_temp", "ERA5_LAND"), ("era5_land_temp", "ERA5_LAND"), ("era5_landx_t", "ERA5"), ("era5_t", "ERA5"), ("x_y", "X")]


def test_curves_at_points(spark):
    planes = [("m", "precip", h, 1, 1, v) for h, v in ((3, 2.0), (6, 1.0), (12, None), (18, 4.0))] + [("m", "temp", h, 1, 1, 20.26) for h in (0, 6)] + [("m", s, 6, 1, 1, v) for s, v in (("u10", 3.0), ("v10", 4.0), ("mslp", 1013.25))]
    df = spark.createDataFrame(planes, "model string, stream string, lead int, row long, col long, value double")
    pts = spark.createDataFrame([("a", 60.0, -150.0), ("sea", -60.0, 0.0), ("bad", 95.0, 0.0)], "point_id string, lat double, lon double")
    got = {r.lead: r for r in places.point_timeseries(pts, df, [0, 3, 4, 6, 9, 18, 24], 7, 12, 30.0).where("point_id = 'a'").collect()}
    assert [got[k].precip for k in (0, 3, 4, 6, 9, 18, 24)] == [2.0, 2.0, 1.0, 1.0, None, 4.0, None]
    assert [got[k].accumulated for k in (0, 3, 4, 6, 9, 18, 24)] == [0.0, 6.0, 7.0, 9.0, None, None, None]
    assert (got[6].wind_speed, got[6].wind_direction, got[6].temperature, got[6].pressure) == (5.0, 216, 20.3, 1013.2) and got[3].temperature is None


def test_folders_of_units_are_pruned(spark, tmp_path):
    path = str(tmp_path / "units")
    places.write_units(spark.createDataFrame([(11000001, 1.0), (12000001, 2.0), (71000001, 3.0), (72000001, 4.0)], "comid long, area double"), path, "comid")
    stored = spark.read.parquet(path)
    found = places.unit_lookup(spark.createDataFrame([(71000001,), (79999999,)], "comid long"), stored, "comid")
    assert [(r.comid, r.area) for r in found.collect()] == [(71000001, 3.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    with pytest.raises(Exception, match="no such unit"):
        places.unit_lookup(spark.createDataFrame([(7,)], "comid long"), stored, "comid").collect()


def test_lines_of_levels(spark):
    line = lambda *xy: [(float(x), float(y)) for x, y in xy]
    rows = [(1, 2, 5.0, True, line((1, 1), (0, 0))), (2, 0, 9.0, True, line((1, 1), (2, 2))), (3, 2, 7.0, False, line((9, 9))), (4, 2, 3.0, True, line((0, 0), (30, 30)))]
    df = spark.createDataFrame(rows, "k long, down long, area double, has_forecast boolean, line array<struct<lon:double,lat:double>>")
    turned = {r.k: [tuple(p) for p in r.line] for r in places.orient_reaches(df, "k", "down", "line").collect()}
    assert turned[1] == [(0.0, 0.0), (1.0, 1.0)] and turned[2] == [(1.0, 1.0), (2.0, 2.0)] and turned[4][0] == (30.0, 30.0)
    severity = spark.createDataFrame([(1, 3), (3, 4)], "k long, severity int")
    level = {r.k: r.severity for r in places.level_features(df, -1.0, -1.0, 1.0, 1.0, severity, "k").collect()}
    assert level == {1: 3, 2: 0, 4: 0}
    active = spark.createDataFrame([(1,), (2,), (4,)], "k long")
    out = {r.k: r.promoted for r in places.promote_active(df.where("k = 2"), df, active, "k", 1.0).collect()}
    assert out == {2: False, 1: True, 4: True}
    assert {r.k for r in places.promote_active(df.where("k = 2"), df, active, "k", 100.0).collect()} == {2}


def test_networks_are_matched_in_turn(spark):
    clicks = spark.createDataFrame([("a", 0.0, 0.0, 100.0), ("b", 50.0, 0.0, 100.0), ("c", 0.0, 0.0, -1.0)], "point_id string, lat double, lon double, target_area double")
    r = "reach_id long, lat1 double, lon1 double, lat2 double, lon2 double, area double"
    one = spark.createDataFrame([(1, 0.0, 0.05, 0.0, 0.07, 400.0)], r)
    two = spark.createDataFrame([(7, 0.0, 0.04, 0.0, 0.05, 50.0), (8, 0.0, 0.1, 0.0, 0.12, 420.0)], r)
    got = {x.point_id: x for x in places.cross_network_match(clicks, {"one": one, "two": two}, ["one", "two"], 15.0, 30.0, 5.0, 5.0, 0.0).collect()}
    assert set(got) == {"a", "b"} and got["a"].one.reach_id == 1 and got["a"].target_area == 400.0 and got["a"].two.reach_id == 8
    assert got["b"].one is None and got["b"].two is None and got["b"].target_area == 100.0


def test_outputs_by_subdataset(spark, tmp_path):
    places.partition_outputs(spark.createDataFrame([("camels_1", 1), ("camels_2", 2), ("lamah_1", 3)], "basin string, v int"), str(tmp_path / "o"), "basin", files=2)
    back = spark.read.parquet(str(tmp_path / "o"))
    assert {(r.subdataset, r.v) for r in back.collect()} == {("camels", 1), ("camels", 2), ("lamah", 3)}


def test_points_of_units(spark):
    rows = [(1, 0.0, 0.0, 10.0, 5, False), (2, 0.0, 0.0, 8.0, 5, True), (3, 0.0, 0.0, 9.0, None, False), (4, 0.0, 0.0, 9.0, None, False), (5, 99.0, 0.0, 99.0, 6, True)]
    df = spark.createDataFrame(rows, "point_id long, lat double, lon double, area double, unit long, has_forecast boolean")
    got = [r.point_id for r in places.top_points(df, -1.0, -1.0, 1.0, 1.0, 5.0, "unit", 2).collect()]
    assert got == [3, 4]
