"""Ring cells, products written by several tasks, resumption, numbers of text tables, stale forecasts."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions.weather import planar_area_km2
from freshet.operators import models, network, peaks
from freshet.sources import providers, tables

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_ring_cells_add_up_to_the_ring():
    rng = np.random.default_rng(2)
    for _ in range(20):
        angle = np.sort(rng.uniform(0, 2 * math.pi, 12))
        size = rng.uniform(2, 9, 12)
        ring = np.column_stack([10.3 + size * np.cos(angle), -4.7 + size * np.sin(angle)])
        x, y = ring.T
        area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
        found = peaks.ring_cells(ring, 1.5)
        plain = {(i, j): a / math.cos(math.radians(i * 1.5 - 90 + 0.75)) for i, j, a in found}
        assert sum(plain.values()) == pytest.approx(area, rel=1e-9)
        for (i, j), a in plain.items():
            box = (j * 1.5 - 180, i * 1.5 - 90, j * 1.5 - 178.5, i * 1.5 - 88.5)
            assert a == pytest.approx(peaks.clipped_area([tuple(p) for p in ring.tolist()], *box), abs=1e-9)


def test_weights_of_rings_with_holes(spark):
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    rows = [("a", False, box(0.0, 0.0, 2.0, 1.0)), ("a", True, box(1.0, 0.0, 1.5, 1.0)), ("dot", False, [(5.2, 5.2)] * 3), ("line", False, box(179.0, 0.0, 181.0, 1.0))]
    rings = spark.createDataFrame(rows, "basin string, is_hole boolean, pts array<struct<lon:double,lat:double>>")
    got = {(r.basin, r.lat_idx, r.lon_idx): r.weight for r in peaks.cell_weights(rings, 1.0).collect()}
    assert got["a", 90, 180] == pytest.approx(2 / 3) and got["a", 90, 181] == pytest.approx(1 / 3)
    assert got["dot", 95, 185] == 1.0 and got["line", 90, 359] == got["line", 90, 0] == pytest.approx(0.5)


def test_nearest_takes_any_radius(spark):
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, -89.9, 0.0)], "point_id long, lat double, lon double")
    gauges = spark.createDataFrame([(7, 10.001, 10.0), (8, 12.0, 10.0), (9, -89.95, 180.0)], "gauge_id long, g_lat double, g_lon double")
    for km, wanted in ((0.5, {1: 7}), (20.0, {1: 7, 2: 9}), (3000.0, {1: 7, 2: 9})):
        assert {r.point_id: r.gauge_id for r in network.nearest(points, gauges, km).collect()} == wanted
        assert {r.point_id: r.gauge_id for r in network.nearest(points, gauges, km, 5.0).collect()} == wanted


def test_products_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(f"b{i}", DAY(0), float("nan") if i == 3 else float(i)) for i in range(40)], "basin string, date date, rain double")
    tables.write_product(df, path, ["rain"], files=4)
    assert 1 < len(list((tmp_path / "p" / "date=2024-01-01").glob("*.parquet"))) <= 4
    back = tables.read_product(spark, path, ["rain"])
    assert back.count() == 40 and back.where("rain IS NULL").count() == 1  # NaN is missing


def test_a_new_run_follows_the_last_stored_day(spark):
    stored = spark.createDataFrame([(DAY(i), 1.0) for i in range(3)], "date date, value double")
    asked = lambda *n: spark.createDataFrame([(DAY(i),) for i in n], "date date")
    assert [r.date for r in tables.plan_resume(stored, asked(1, 2, 3, 4)).orderBy("date").collect()] == [DAY(3), DAY(4)]
    assert tables.plan_resume(stored, asked(0, 1)).count() == 0
    with pytest.raises(ValueError, match="doesn't follow"):
        tables.plan_resume(stored, asked(5, 6))


def test_numbers_of_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gauge_id,area,name,odd\nx,1.5,7a,NaN\ny,2,b,3\n")
    r = {x.basin: x for x in tables.read_attribute_tables(spark, [[str(tmp_path / "a.csv")]], numeric=True).collect()}
    assert (r["x"].area, r["y"].area, r["x"].name, r["x"].odd, r["y"].odd) == (1.5, 2.0, "7a", None, 3.0)


def test_stale_issues_are_no_forecasts(spark):
    p = lambda issue: json.dumps({"issue": issue, "forecasts": [{"time": "2024-01-05", "mean": 1.0}]})
    df = spark.createDataFrame([("old", p("2024-01-01 00:00:00")), ("new", p("2024-01-02 12:00:00"))], "k string, p string")
    assert {r.k for r in providers.forecast_records(df, "k", "p", "2024-01-03 00:00:00").collect()} == {"new"}
    assert providers.forecast_records(df, "k", "p").count() == 2


def test_planar_areas(spark):
    assert spark.range(1).select(planar_area_km2(F.lit(2.0), F.lit(60.0)).alias("a")).first().a == pytest.approx(111.0**2)


def test_payloads_of_all_shapes(spark):
    shapes = {
        1: {"return_period_2": 10.0, "return_period_5": [20.0, 1.0], "return_period_100": {"1": 90.0, "x": 1.0}, "return_period_3": 5.0, "other": 1.0},
        2: {"data": {"2": 10.0, "5": 20.0, "10": 30.0}, "return_period_2": 11.0},
        3: {"return_period": [2, 5, 10, 25], "gumbel": [10.0, 20.0, "30", 40.0]},
        4: {"4": {"return_period_2": {"z": 7.0}, "return_period_20": 50.0, "return_period_50": "60"}},
        5: {"return_period_2": 1.0, "return_period_5": None},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in shapes.items()] + [(6, "no json"), (7, None)], "id long, p string")
    got = {}
    for r in providers.return_period_payloads(df, "id", "p").collect():
        got.setdefault(r.id, {})[r.period] = r.flow
    assert set(got) == {1, 2, 3, 4} and all(set(providers.CANONICAL) <= set(v) for v in got.values())
    assert {k: got[1][k] for k in (2.0, 5.0, 100.0)} == {2.0: 10.0, 5.0: 20.0, 100.0: 90.0} and got[2][2.0] == 11.0
    assert {k: got[3][k] for k in (2.0, 5.0, 10.0, 25.0)} == {2.0: 10.0, 5.0: 20.0, 10.0: 30.0, 25.0: 40.0} and got[4][2.0] == 7.0 and 7.0 < got[4][5.0] < 50.0


def test_residuals_persist(spark):
    base = spark.createDataFrame([("a", DAY(i), 10.0, 5.0) for i in range(6)] + [("b", DAY(0), 1.0, 1.0)], "k string, d date, q double, low double")
    seen = spark.createDataFrame([("a", DAY(1), 14.0), ("a", DAY(2), 12.0), ("a", DAY(3), -1.0), ("a", DAY(5), 2.0)], "k string, d date, o double")
    got = {(r.k, r.d): r for r in models.nudged(base, seen, "k", "d", "q", "o", 0.5, 1.0, 2, "2024-01-04", ["low"]).collect()}
    assert [got["a", DAY(i)].q for i in range(6)] == [10.0, 10.0, 13.0, 11.5, 10.75, 10.375] and got["a", DAY(2)].low == 8.0 and got["a", DAY(2)].anchor == DAY(2)
    assert got["b", DAY(0)].q == 1.0 and got["b", DAY(0)].delta is None
    floor = {r.d: r.q for r in models.nudged(base, seen, "k", "d", "q", "o", 2.0, 2.0, 1).where("k = 'a'").collect()}
    assert floor[DAY(5)] == 2.0 and floor[DAY(4)] == 10.0
    assert models.half_life(0.5) == 1.0 and models.half_life(1.0) is None
