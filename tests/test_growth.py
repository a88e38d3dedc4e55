"""Rows that repeat places, shapes and boxes: met once, expanded in the end, no side of unknown size broadcast."""

import pytest

from freshet.operators import network, peaks, places, samples, snapping


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_decimal_shares_end_in_halves(spark):
    # 57 days, of which 45 are usable; 45 at 0.7 are 31.5, which goes to the even 32
    days = spark.sql("SELECT 'a' AS k, date_add(DATE '2024-01-01', i) AS d FROM (SELECT explode(sequence(0, 56)) AS i)")
    assert samples.partition_dates(days, "k", "d", 0.7, 1, 8, 5).first().train_days == 32  # was 31: 45 * 0.7 in doubles is below 31.5


def test_every_vertex_counts(spark):
    lines = spark.createDataFrame([("long", [(i,) for i in range(13)]), ("none", [])], "k string, vertices array<struct<c:long>>")
    ranks = spark.createDataFrame([(1, 9), (3, 2)], "c long, rank int")
    assert {r.k: r["rank"] for r in snapping.max_rank(lines, ranks, "k", ["c"], every=True).collect()} == {"long": 9, "none": 0}


def test_planes_meet_points_without_a_shuffle_of_both(spark):
    plane = spark.createDataFrame([(k, r, c, float(100 * k + 10 * r + c)) for k in range(3) for r in range(7) for c in range(12) if (k, r, c) != (2, 0, 1)], "k long, row long, col long, value double")
    pts = spark.createDataFrame([(1, 75.0, -165.0), (1, 75.0, -165.0), (2, 90.0, -180.0), (3, 75.0, 165.0), (4, 75.0, -165.0)], "point_id long, lat double, lon double")
    df = places.bilinear_sample(pts, plane, ["k"], 7, 12, 30.0)
    got = {(r.point_id, r.k): r.value for r in df.collect()}
    assert df.count() == 12 and got[1, 0] == got[4, 0] == pytest.approx(5.5) and got[4, 2] is None and got[1, 2] == pytest.approx(207.0) and got[2, 2] == 200.0 and got[3, 1] == pytest.approx((111 + 100 + 121 + 110) / 4)
    text = plan(df)
    assert text.index("Join") < text.index("Exchange") and text.index("Join") < text.index("Aggregate")


def test_units_of_one_shape(spark):
    ring = lambda x: [(x, 0.0), (x + 2, 0.0), (x + 2, 2.0), (x, 2.0)]
    points = spark.createDataFrame([(i, 1.0, 1.0 if i < 4 else 179.5) for i in range(6)] + [(0, 1.0, 3.5)], "point_id long, lat double, lon double")
    units = spark.createDataFrame([(i, ring(0.0 if i < 3 else 179.0)) for i in range(5)] + [(0, ring(3.0))], "unit_id long, ring array<struct<lon:double,lat:double>>")
    df = network.locate_units(points, units)
    wanted = [(p, u) for p in range(4) for u in range(3)] + [(p, u) for p in (4, 5) for u in (3, 4)] + [(0, 0)]
    assert sorted((r.point_id, r.unit_id) for r in df.collect()) == sorted(wanted)
    assert "Broadcast" not in plan(df)


def test_gauges_of_one_place(spark):
    points = spark.createDataFrame([(i, 10.0, 20.0) for i in range(50)] + [(99, None, 1.0)], "point_id long, lat double, lon double")
    gauges = spark.createDataFrame([(9, 11.0, 20.0), (4, 11.0, 20.0), (3, 12.0, 20.0)], "gauge_id long, g_lat double, g_lon double")
    df = network.nearest(points, gauges, 300.0)
    assert {r.point_id: r.gauge_id for r in df.collect()} == dict.fromkeys(range(50), 4)
    text = plan(df)
    assert "Broadcast" not in text and "keys=[lat" in text


def test_boxes_of_equal_sides(spark):
    box = lambda i, x: (i, x, x, x + 2, x + 2)
    a = spark.createDataFrame([box(i, 0.0) for i in range(3)] + [box(0, 8.0)], "id long, south double, west double, north double, east double")
    b = spark.createDataFrame([box(i, 1.0) for i in range(4)] + [box(7, 9.0)], a.schema)
    df = snapping.overlap_boxes(a, b, 1.0)
    assert sorted((r.a_id, r.b_id, r.overlap, r.a_area) for r in df.collect()) == sorted([(i, j, 1.0, 4.0) for i in range(3) for j in range(4)] + [(0, 7, 1.0, 4.0)])
    assert "Broadcast" not in plan(df) and snapping.overlap_boxes(a, b, 1.0, 1.0).count() == 0


def test_reaches_of_one_course(spark):
    points = spark.createDataFrame([(i, 10.0, 20.0, 100.0 if i % 2 else None) for i in range(6)] + [(9, 60.0, 20.0, 1.0)], "point_id long, lat double, lon double, target_area double")
    rows = [(5, 10.0, 20.1, 10.1, 20.1, 4000.0), (4, 10.0, 20.1, 10.1, 20.1, 4000.0), (3, 10.0, 20.1, 10.1, 20.1, 90.0), (2, 10.5, 20.1, 10.6, 20.1, 100.0)]
    reaches = spark.createDataFrame(rows, "reach_id long, lat1 double, lon1 double, lat2 double, lon2 double, area double")
    df = snapping.snap_to_reach(points, reaches, 30.0, 0.3)
    assert {r.point_id: r.reach_id for r in df.collect()} == dict.fromkeys(range(6), 4)
    text = plan(df)
    assert "Broadcast" not in text and "keys=[lat" in text
    df = snapping.snap_by_area(points, reaches, 30.0, 100.0, 2.0, 2.0, 0.3)
    assert {r.point_id: r.reach_id for r in df.collect()} == {i: 3 if i % 2 else 4 for i in range(6)} | {9: None}
    assert "Aggregate" not in plan(df)[: plan(df).index("Join")]


def test_equal_rings_are_cut_once(spark, monkeypatch):
    ring = [(0.5, 0.0), (2.5, 0.0), (2.5, 1.0), (0.5, 1.0)]
    rings = spark.createDataFrame([(i, False, ring) for i in range(40)] + [(i, True, [(0.5, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 1.0)]) for i in range(0, 40, 2)], "basin long, is_hole boolean, pts array<struct<lon:double,lat:double>>").coalesce(1)
    df = peaks.cell_weights(rings, 1.0)
    got = {(r.basin, r.lon_idx): r.weight for r in df.collect()}
    assert all(got[i, 181] == pytest.approx(0.5 if i % 2 else 2 / 3) and ((i, 180) in got) == bool(i % 2) for i in range(40))
    text = plan(df)
    assert "MapInArrow" in text and "Exchange" in text[text.index("MapInArrow") :]
