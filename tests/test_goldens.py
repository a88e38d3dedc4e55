"""Literal fixtures with known results."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import mixture, weather
from freshet.operators import frame, frequency, network, peaks, skill, zonal


def days(values, key=1, start=dt.date(2020, 1, 1)):
    return [(key, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]


@pytest.mark.parametrize("values, mean, missing", [([10, 10, 10, 10, None], 10.0, 0.2), ([10, 10, 10, None, None], None, 0.4)])
def test_coverage_rule(spark, values, mean, missing):
    grid = spark.createDataFrame([(0, i, "d", None if v is None else float(v)) for i, v in enumerate(values)], "lat_idx int, lon_idx int, t string, value double")
    weights = spark.createDataFrame([("b", 0, i, 0.2) for i in range(5)], "basin string, lat_idx int, lon_idx int, weight double")
    row = zonal.zonal_reduce(grid, weights, ["t"]).first()
    assert row["value"] == (pytest.approx(mean) if mean else None)
    assert row["missing_fraction"] == pytest.approx(missing)


@pytest.mark.parametrize("values, at", [([1, 5, 6, 2, 5.5, None, 7], [1, 4]), ([6, 7, 1, 5], [0, 3])])
def test_up_crossings(spark, values, at):
    df = spark.createDataFrame(days(values), "k int, t date, q double")
    rows = df.withColumn("c", frame.up_crossings(df, "k", "t", "q", F.lit(5.0))).orderBy("t").collect()
    assert [i for i, r in enumerate(rows) if r["c"]] == at


def scores(spark, obs, sim):
    rows = [(1, d, o, s, 5.0) for (_, d, o), (_, _, s) in zip(days(obs), days(sim))]
    return frequency.flood_event_scores(spark.createDataFrame(rows, "k int, t date, obs double, sim double, thr double"), "k", "t", 2, "thr", "thr").first()


def test_event_scores(spark):
    obs, sim, flat = [0.0] * 20, [0.0] * 20, [0.0] * 20
    obs[5] = obs[15] = 10
    sim[6] = 8
    r = scores(spark, obs, sim)
    assert (r["precision"], r["recall"], r["n_obs"], r["n_sim"]) == (1.0, 0.5, 2, 1) and r["f1"] == pytest.approx(2 / 3)
    r = scores(spark, flat, flat)
    assert (r["precision"], r["recall"], r["f1"], r["n_obs"], r["n_sim"]) == (None, None, None, 0, 0)
    r = scores(spark, obs, flat)
    assert (r["precision"], r["recall"], r["f1"]) == (None, 0.0, 0.0)


def test_annual_maxima_and_greedy_peaks(spark):
    series, start = [1.0] * 1096, dt.date(2018, 1, 1)
    for day, v in ((100, 500), (465, 800), (830, 650), (700, 300)):
        series[day] = v
    df = spark.createDataFrame(days(series, start=start), "k int, t date, q double")
    assert [r["peak"] for r in frequency.annual_maxima(df, "k", "t", "q").orderBy("year").collect()] == [500, 800, 650]
    peaks = frequency.peaks_over_threshold(df, "k", "t", "q", 60, 0.95).orderBy("rank").collect()
    assert [r["peak"] for r in peaks] == [800, 650, 500, 300]


def test_special_functions():
    assert frequency.gamma_cdf(1.0, 2.0) == pytest.approx(1 - math.exp(-2), rel=1e-14)
    for a in (0.3, 2.5, 40.0, 400.0):
        for p in (1e-4, 0.2, 0.9, 0.9999):
            assert frequency.gamma_cdf(a, frequency.gamma_ppf(a, p)) == pytest.approx(p, rel=1e-10)
    assert frequency.normal_ppf(0.975) == pytest.approx(1.959963984540054, rel=1e-12)
    assert frequency.pearson3_ppf(0.99, 0.0, 1.0, 1e-3) == pytest.approx(frequency.pearson3_ppf(0.99, 0.0, 1.0, 0.0), abs=1e-3)


def test_skill_of_flat_and_equal_series(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 4.0, 4.0), (2, 1.0, 2.0), (2, 1.0, 3.0), (3, 1.0, None)], "k int, obs double, sim double")
    got = {r["k"]: r for r in skill.skill(df, ["k"]).collect()}
    assert got[1]["nse"] == 1 and got[1]["kge"] == pytest.approx(1) and got[2]["nse"] is None and 3 not in got


def test_closures_of_long_chains_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1, 1.0) for i in range(1, 201)], "n long, d long, a double")
    got = network.upstream_closure(chain, "n", "d")
    assert got.count() == 200 * 201 // 2 and got.agg(F.max("hops")).first()[0] == 199
    sums = {r["start"]: tuple(r)[1:] for r in network.contributing(chain, "n", "d", "a").collect()}
    assert sums == {i: (201 - i, 201.0 - i, 200 - i) for i in range(1, 201)}
    ring = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "n long, d long, a double")
    for f in (lambda: network.upstream_closure(ring, "n", "d"), lambda: network.contributing(ring, "n", "d", "a")):
        with pytest.raises(ValueError):
            f()


def test_return_periods_of_flat_and_missing_levels(spark):
    rows = [(1, 5.0, 5.0, 5.0), (2, 1.0, 2.0, 3.0), (3, None, 2.0, 4.0), (4, 1.0, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double")
    levels = [(2.0, F.col("a")), (5.0, F.col("b")), (20.0, F.col("c"))]
    got = {r["k"]: (r["low"], r["at"]) for r in df.select("k", frequency.return_period_estimate(F.lit(0.5), levels).alias("low"), frequency.return_period_estimate(F.lit(3.0), levels).alias("at")).collect()}
    assert got[1] == (None, None) and got[2] == (None, pytest.approx(20)) and 5 < got[3][1] < 20 and got[4] == (None, pytest.approx(20))


def test_nearest_across_the_antimeridian_and_at_the_pole(spark):
    points = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.9, 0.0), (3, 0.0, 0.0)], "point_id int, lat double, lon double")
    gauges = spark.createDataFrame([(7, 0.0, -179.9), (8, 89.9, 170.0)], "gauge_id int, g_lat double, g_lon double")
    assert {r["point_id"]: r["gauge_id"] for r in network.nearest(points, gauges, 100.0).collect()} == {1: 7, 2: 8}


def test_clip_and_transform_keep_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (100.0,)], "q double")
    assert [r[0] for r in frame.apply_band_transform(df, "q", 1.0, -10.0, 0.0).collect()] == [0.0, None, 90.0]
    got = df.select(weather.reference_et(F.lit(100.0), F.col("q"), F.lit(0.0), F.lit(2.0), F.lit(5.0)).alias("e")).collect()
    assert got[1]["e"] is None and got[0]["e"] >= 0


def test_d8_edges(spark):
    got = network.d8_edges(spark.createDataFrame([(0, 0, 1), (0, 1, 4), (1, 1, 0)], "row int, col int, code int")).collect()
    assert [(r["down_row"], r["down_col"]) for r in got] == [(0, 1), (1, 1), (None, None)]


def test_peaks(spark):
    assert peaks.find_peaks(np.array([0, 1, 1, 1, 0, 3, 0, 2.0])).tolist() == [2, 5]
    assert peaks.find_peaks(np.array([0, 2, 0, 3, 0, 1, 0.0]), distance=3).tolist() == [3]
    assert peaks.prominences(np.array([0, 2, 1, 3, 0.0]), np.array([1, 3])).tolist() == [1, 3]
    obs, sim = np.zeros(500), np.zeros(500)
    obs[[100, 250, 400]] = 10.0
    sim[[101, 250, 398]] = 10.0
    rows = [(1, d, o, s) for (_, d, o), (_, _, s) in zip(days(obs), days(sim))]
    flat = [(2, d, o, 0.0) for _, d, o, _ in rows] + [(3, rows[0][1], 1.0, None)]
    got = {r["k"]: r for r in peaks.peak_metrics(spark.createDataFrame(rows + flat, "k int, t date, obs double, sim double"), "k", "t").collect()}
    assert got[1]["peak_timing"] == 1.0 and got[1]["missed_peaks"] == pytest.approx(1 / 3)
    assert got[2]["missed_peaks"] == 1.0 and got[2]["peak_mape"] == 100.0 and 3 not in got


def test_cell_weights(spark):
    square = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    rows = [("box", False, square(0.0, 0.0, 2.0, 1.0)), ("ring", False, square(0.0, 0.0, 3.0, 1.0)), ("ring", True, square(1.0, 0.0, 2.0, 1.0)), ("dot", False, square(0.5, 0.5, 0.5, 0.5))]
    rings = spark.createDataFrame(rows, "basin string, is_hole boolean, pts array<struct<lon: double, lat: double>>")
    got = {(r["basin"], r["lat_idx"], r["lon_idx"]): round(r["weight"], 9) for r in peaks.cell_weights(rings, 1.0).collect()}
    assert got == {("box", 90, 180): 0.5, ("box", 90, 181): 0.5, ("ring", 90, 180): 0.5, ("ring", 90, 182): 0.5, ("dot", 90, 180): 1.0}


def test_mixture_quantiles_invert_the_distribution(spark):
    df = spark.createDataFrame([([(20.0, 2.0, 0.3, 0.6), (20.5, 1.0, 0.5, 0.4)],)], "c array<struct<mu: double, b: double, tau: double, pi: double>>")
    c = F.col("c")
    assert df.select(mixture.mixture_cdf(c, F.lit(1e3))).first()[0] == pytest.approx(1)
    single = spark.createDataFrame([([(10.0, 2.0, 0.4, 1.0)],)], "c array<struct<mu: double, b: double, tau: double, pi: double>>")
    q = single.select(mixture.component_quantile(c[0], 0.7).alias("q"), mixture.mixture_mean(c).alias("m"))
    assert single.select(mixture.mixture_cdf(c, F.lit(q.first()["q"]))).first()[0] == pytest.approx(0.7)
    assert q.first()["m"] == pytest.approx(10 + 2 * 0.2 / 0.24)
