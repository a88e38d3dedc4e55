"""Outlets, stems, chains and pour points on small rivers with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import network, outlets

CELLS = "row long, col long, code int, area double"


def creek_and_river(spark):
    """A creek of three cells, and a river of thirty 35 columns east of it that ends in a cell without direction."""
    area = 0.0066
    cells = [(98, 100, 4), (99, 100, 4), (100, 100, 0), *[(r, 135, 4) for r in range(71, 101)], (101, 135, 0)]
    return spark.createDataFrame([(*c, area) for c in cells], CELLS)


@pytest.mark.parametrize("side", [8, 64, 512])
def test_expected_area_leads_past_a_creek(spark, side):
    raster = outlets.accumulation(creek_and_river(spark), side)
    points = spark.createDataFrame([("plain", 100, 100, None), ("hint", 100, 100, 0.20), ("far", 100, 100, 5000.0), ("bad", 100, 100, -1.0), ("sea", 4000, 4000, 1.0), ("nan", 100, 100, float("nan"))], "point_id string, row long, col long, expected_area double")
    wide = 4096  # the search may cross the tiles of the accumulation
    got = {r.point_id: r for r in outlets.area_guided_outlets(points, raster, 0.4, 12, 60, wide).collect()}
    assert (got["plain"].status, got["plain"].cells) == ("snapped", 3)
    assert (got["hint"].status, got["hint"].cells, got["hint"].row, got["hint"].col) == ("found", 30, 100, 135)
    assert got["far"].status == "mismatch" and got["far"].row is None and got["far"].closest_area == pytest.approx(30 * 0.0066)  # of cells with a direction
    assert got["bad"].status == got["nan"].status == "bad_hint" and got["sea"].status == "no_cell" and len(got) == 6


def test_accumulation_by_tiles_of_any_size(spark):
    rng = np.random.default_rng(5)
    n = 40
    codes = rng.choice([1, 2, 4, 8], (n, n))
    cells = [(r - 7, c - 13, int(codes[r, c]), float(r + 1)) for r in range(n) for c in range(n) if rng.random() > 0.05]  # holes, places below zero
    there = {(r, c): (code, a) for r, c, code, a in cells}
    step = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1)}
    count = {k: 1 for k in there}
    total = {k: a for k, (_, a) in there.items()}
    for r, c in sorted(there, key=lambda k: (k[0], k[1])):  # directions lead down or right
        to = tuple(np.add((r, c), step[there[r, c][0]]).tolist())
        if to in there:
            count[to] += count[r, c]
            total[to] += total[r, c]
    df = spark.createDataFrame(cells, CELLS)
    for side in (5, 16, 512):
        got = {(x.row, x.col): (x.cells, x.upstream_area) for x in outlets.accumulation(df, side).collect()}
        assert got == {k: (count[k], total[k]) for k in there}
    assert outlets.accumulation(df.limit(0), 16).count() == 0


def test_a_cycle_is_an_error(spark):
    loop = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 16, 1.0)], CELLS)
    with pytest.raises(Exception, match="cycle"):
        outlets.accumulation(loop, 8).collect()
    across = spark.createDataFrame([(0, 7, 1, 1.0), (0, 8, 16, 1.0)], CELLS)
    with pytest.raises(Exception, match="cycle"):
        outlets.accumulation(across, 8).collect()


def test_side_channel_is_left_for_the_reach(spark):
    raster = outlets.accumulation(creek_and_river(spark), 512).withColumn("upstream_area", F.col("cells") * 1.0)
    degrees = 0.001
    points = spark.createDataFrame([("a", 39.9, -89.9), ("b", 39.9, -80.0)], "point_id string, lat double, lon double")
    reaches = spark.createDataFrame([(7, 39.9, -89.9, 39.899, -89.9, 30.0)], "reach_id long, lat1 double, lon1 double, lat2 double, lon2 double, area double")
    got = {r.point_id: r for r in outlets.hybrid_outlets(points, reaches, raster, 40.0, -90.0, degrees, side=4096).collect()}
    assert (got["a"].status, got["a"].cells, got["a"].reach_id) == ("found", 30, 7)  # from 13.5 to 46.5 fits, and the nearest such cell has 30
    assert got["b"].status == "no_cell" and got["b"].reach_id is None
    plain = {r.point_id: r for r in outlets.hybrid_outlets(points, reaches, raster, 40.0, -90.0, degrees, hints=(100.0, 1000.0), side=4096).collect()}
    assert (plain["a"].status, plain["a"].cells) == ("snapped", 3)


def test_cell_area(spark):
    r = spark.range(1).select(outlets.cell_area(F.lit(0), 60.0, 1.0).alias("a"), outlets.cell_area(F.lit(0), 90.0, 1.0).alias("b")).first()
    assert r.a == pytest.approx(111.32**2 / 2, rel=1e-12) and r.b == pytest.approx(111.32**2 * 0.05)


def test_main_stem_through_a_reach(spark):
    rows = [(101, 102, 50000.0), (102, 103, 52000.0), (103, 0, 55000.0), (104, 102, 60000.0), (105, 104, 1.0), (106, 104, 1.0)]
    reaches = spark.createDataFrame(rows, "id long, next long, area double")
    starts = spark.createDataFrame([(102,), (105,), (999,)], "id long")
    got = network.main_stem_chain(starts, reaches, "id", "next", "area").collect()
    chain = lambda s: [r.node for r in sorted(got, key=lambda r: r.step) if r.start == s]
    assert chain(102) == [105, 104, 102, 103] and chain(105) == [105, 104, 102, 103] and not chain(999)
    three = spark.createDataFrame(rows[:3], "id long, next long, area double")
    assert network.main_stem_chain(starts.where("id = 102"), three, "id", "next", "area").count() == 3
    assert network.main_stem_chain(starts.where("id = 105"), reaches, "id", "next", "area", 1).count() == 2
    loop = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "id long, next long, area double")
    assert sorted(r.node for r in network.main_stem_chain(loop.select("id").where("id = 1"), loop, "id", "next", "area").collect()) == [1, 2, 3]


def test_chains_are_cut_at_confluences(spark):
    rows = [(1, 3), (2, 3), (3, 4), (4, 5), (5, 0), (6, 5), (8, 9), (9, 8), (10, None)]
    df = spark.createDataFrame(rows, "id long, next long")
    by = lambda found: {c: [(r.node, r.own) for r in sorted(found, key=lambda r: r.position) if r.chain == c] for c in {r.chain for r in found}}
    got = by(network.split_chains(df, "id", "next", F.lit(True)).collect())
    assert {k: [n for n, _ in v] for k, v in got.items()} == {1: [1], 2: [2], 3: [3, 4], 5: [5], 6: [6], 10: [10]}  # 8 and 9 are a cycle
    ends = by(network.split_chains(df, "id", "next", F.lit(True), include_end=True).collect())
    assert ends == {1: [(1, True), (3, False)], 2: [(2, True), (3, False)], 3: [(3, True), (4, True), (5, False)], 6: [(6, True), (5, False)]}
    kept = by(network.split_chains(df, "id", "next", F.col("id") != 2).collect())
    assert [n for n, _ in kept[1]] == [1, 3, 4]


def test_pour_points(spark):
    rows = [("a", 1, 2, 100.0, 80.0, 10.0), ("a", 2, 3, 100.0, 90.0, 20.0), ("a", 3, 0, 100.0, 95.0, 50.0)]
    rows += [("b", 1, 2, 100.0, 99.0, 10.0), ("b", 2, 3, 100.0, 90.0, 20.0), ("b", 3, 4, 100.0, 10.0, 50.0), ("b", 7, 3, 100.0, 60.0, 5.0), ("b", 8, 3, 100.0, 0.0, 7.0)]
    rows += [("c", 5, 6, 0.0, 9.0, 4.0)]
    df = spark.createDataFrame(rows, "basin string, id long, next long, area double, overlap double, q double")
    got = {r.basin: (r.pour_point, r.units, r.q) for r in network.pour_point_sums(df, "basin", "id", "next", "overlap", "area", ["q"]).collect()}
    assert got == {"a": (0, 1, 50.0), "b": (3, 2, 25.0), "c": (6, 1, 4.0)}
    strict = {r.basin: (r.pour_point, r.units, r.q) for r in network.pour_point_sums(df, "basin", "id", "next", "overlap", "area", ["q"], 1000.0).collect()}
    assert strict["c"] == (6, 0, 4.0) and strict["b"] == (3, 2, 25.0)
