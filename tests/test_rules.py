"""Rules of planning, lookups, parity and summaries on rows with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshet.operators import frame, models, samples, snapping

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_lookup_by_shortened_degrees_and_ratio(spark):
    points = spark.createDataFrame([("north", 60.0, 10.0, 302.0), ("far", 60.0, 20.0, 302.0), ("small", 0.0, 0.0, 3.0), ("none", 30.0, 30.0, None), ("dateline", 0.0, 179.9, 100.0)], "point_id string, lat double, lon double, target_area double")
    reaches = [(1, 60.0, 10.6, 100.0, 10.0, 20.0, 30.0), (2, 60.0, 20.95, 302.0, 10.0, 20.0, 30.0), (3, 0.0, 0.1, 5.0, 0.0, 1.0, 1.0), (4, 0.0, 0.2, 40.0, 8.0, 9.0, 10.0), (5, 0.0, -179.9, 100.0, 7.0, 8.0, 9.0)]
    df = spark.createDataFrame(reaches, "reach_id long, lat double, lon double, area double, a double, b double, c double")
    got = {r.point_id: r for r in snapping.threshold_lookup(points, df, ["a", "b", "c"]).collect()}
    assert got["north"].reach_id == 1 and got["north"].a == pytest.approx(10 * 3.02**0.75)  # 0.6 degrees of longitude are 0.3 here
    assert got["far"].reach_id is None and got["far"].a == pytest.approx(0.365 * 302**0.75) and got["far"].c == pytest.approx(2.5 * 0.365 * 302**0.75)
    assert got["small"].reach_id == 4 and got["small"].a == pytest.approx(8 * (50 / 40) ** 0.75)
    assert got["none"].b == pytest.approx(1.66 * 0.365 * 500**0.75)
    assert got["dateline"].reach_id == 5 and got["dateline"].a == 7.0


def test_lookup_scale_has_bounds(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 1000.0)], "point_id long, lat double, lon double, target_area double")
    far = spark.createDataFrame([(1, 0.0, 0.0, 331.0, 1.0)], "reach_id long, lat double, lon double, area double, a double")
    assert snapping.threshold_lookup(p, far, ["a"]).first().a == pytest.approx(min(2.5, (1000 / 331) ** 0.75))


def test_near_reaches_come_first(spark):
    p = spark.createDataFrame([("a", 0.0, 0.0, 100.0), ("b", 0.0, 0.0, 2.0)], "point_id string, lat double, lon double, target_area double")
    r = spark.createDataFrame([(1, 0.0, 0.05, 0.0, 0.06, 90.0), (2, 0.0, 0.9, 0.0, 0.91, 1e9), (3, 0.0, 1.0, 0.0, 1.01, 4.0)], "reach_id long, lat1 double, lon1 double, lat2 double, lon2 double, area double")
    got = {x.point_id: (x.reach_id, x.tier) for x in snapping.snap_by_area(p, r, 15.0, 150.0, 5.0, 8.0, 0.3).collect()}
    assert got == {"a": (1, 0), "b": (3, 1)}


def test_runs_begin_where_both_end(spark):
    rows = [("both", DAY(20), DAY(10)), ("state", None, DAY(10)), ("last", DAY(20), None), ("none", None, None), ("late", DAY(99), DAY(98))]
    df = spark.createDataFrame(rows, "k string, last date, state date")
    issue = F.lit(DAY(30))
    get = lambda **k: {r.k: (r.mode, r.begin, r.end) for r in df.select("k", *[c.alias(n) for c, n in zip(samples.plan_window(F.col("last"), F.col("state"), issue, **k), ("mode", "begin", "end"))]).collect()}
    assert get() == {"both": ("hot", DAY(10), DAY(30)), "state": ("hot", DAY(10), DAY(30)), "last": ("resumed", DAY(20), DAY(30)), "none": ("cold", DAY(30 - 365), DAY(30)), "late": ("hot", DAY(30), DAY(30))}
    short = get(lookback=15)
    assert short["both"][1] == DAY(10) and short["last"][1] == DAY(15) and short["none"][1] == DAY(15)


def test_the_first_interval_stands_for_lead_0(spark):
    f = spark.createDataFrame([("r", h, float(h)) for h in (0, 3, 6, 12)], "k string, lead int, v double")
    rates = {r.wanted: r.lead for r in models.lead_step(f, ["k"], "lead", [-3, 0, 3, 4, 12, 13], exact=False).collect()}
    states = {r.wanted: r.lead for r in models.lead_step(f, ["k"], "lead", [-3, 0, 3, 4, 12, 13], exact=True).collect()}
    assert rates == {0: 3, 3: 3, 4: 6, 12: 12} and states == {0: 0, 3: 3, 12: 12}


def test_dates_are_split_with_a_gap(spark):
    rows = [("long", DAY(i)) for i in range(75)] + [("few", DAY(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, d date")
    got = {(s, r.k): r for s in (0.7, 0.85) for r in samples.partition_dates(df, "k", "d", s, 7, 30).collect()}
    r = got[0.7, "long"]
    # 75 days: sequences of 28, samples from day 28 to day 68, of which 35 are usable for training and the gap
    assert (r.sequence, r.shortened, r.train_days) == (28, True, 24) and (r.valid_from - r.train_to).days == 7
    assert (r.train_from, r.train_to, r.valid_from, r.valid_to) == (DAY(28), DAY(51), DAY(58), DAY(68)) and r.validation_days == 11
    assert r.train_to < got[0.85, "long"].train_to
    assert got[0.7, "few"].train_from is None and got[0.7, "few"].days == 20
    with pytest.raises(ValueError):
        samples.partition_dates(df, "k", "d", 0.95, 7, 30)


def test_grids_agree_where_both_are_valid(spark):
    g = lambda vs: spark.createDataFrame([("w", i, v) for i, v in enumerate(vs)], "w string, c long, v double")
    r = models.compare_grids(g([1.0, 2.0, None, None, 5.0]), g([1.0, 2.5, 3.0, None]), ["c"], ["w"], "v").first()
    assert (r.cells, r.both_valid, r.both_missing, r.rebuilt_missing, r.reference_missing) == (5, 2, 1, 1, 1)
    assert (r.mae, r.bias, r.equal, r.near_equal, r.max, r.both_valid_percent) == (0.25, -0.25, 0.5, 0.5, 0.5, 40.0) and r.r == pytest.approx(1.0)
    none = models.compare_grids(g([None, 1.0]), g([1.0, None]), ["c"], ["w"], "v").first()
    assert none.mae is None and none.r is None and none.rebuilt_missing == 1


def test_forcings_are_compared_on_their_own_days(spark):
    s = lambda rows: spark.createDataFrame([("b", 1, DAY(i), o, v) for i, (o, v) in enumerate(rows)], "basin string, lead int, d date, obs double, sim double")
    a = s([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, None), (None, 5.0)])
    b = s([(1.0, 2.0), (2.0, 3.0), (3.0, None), (4.0, None), (None, None)])
    r = models.forcing_delta(a, b, ["basin", "lead"], "d", "obs", "sim").first()
    assert (r.status, r.missing_a, r.missing_b, r.max_apart, r.rmse_a, r.rmse_b) == ("NAN_PRED", 1, 2, 1.0, 0.0, 1.0) and r.nse_a == 1.0
    flat = models.forcing_delta(s([(1.0, 2.0)] * 3), s([(1.0, 2.0)] * 3), ["basin", "lead"], "d", "obs", "sim").first()
    assert flat.status == "OK" and flat.r_apart == 1.0 and flat.nse_a is None and flat.delta_rmse == 0.0


def test_models_speak_together(spark):
    rows = [("x", "a", True, True, "live", 2, "5-yr", "SEVERE"), ("x", "b", True, True, "severity_only", 2, "5-yr b", "WARNING"), ("x", "c", True, False, "live", 4, "no", "EXTREME"), ("x", "d", True, True, "stale", 4, "no", "EXTREME"), ("x", "e", True, True, "live", None, "?", "odd")]
    rows += [("y", "c", False, True, "live", 3, "no", "EXTREME")]
    df = spark.createDataFrame(rows, "k string, m string, available boolean, independent boolean, status string, rank int, label string, risk string")
    got = {r.k: r for r in models.flood_summary(df, "k", "m").collect()}
    x, y = got["x"], got["y"]
    assert (x.models_over, x.models, x.governing, x.max_rank, x.label, x.risk) == (2, 3, "a", 2, "5-yr", "SEVERE")
    assert x.agreement == "2 of 3 independent models forecast ≥ 2-yr exceedance"
    assert (y.models, y.governing, y.max_rank, y.label, y.risk) == (0, None, None, "Unknown", "UNKNOWN")


def test_expected_scores_plain_and_normalised(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0, None), ("a", 5.0, 0.5, None), ("b", 2.0, None, None)], "k string, p double, recall double, f1 double")
    got = {r.k: r for r in models.expected_scores(df, ["k"], "p", ["recall", "f1"], {2.0: 0.5, 5.0: 0.2}).collect()}
    assert got["a"].recall == pytest.approx(0.6) and got["a"].recall_norm == pytest.approx(0.6 / 0.7) and got["a"].f1 is None and got["b"].recall_norm is None


def test_stored_units(spark):
    rows = [("precip", -1.0, "mm/h"), ("precip", 1.0, None), ("precip", 24.0, "mm/day"), ("mslp", 101325.0, None), ("mslp", 1013.25, "hPa"), ("temp", 300.0, None), ("temp", 20.0, None), ("temp", 20.0, "K"), ("u10", -3.0, "m/s"), ("temp", None, "K")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, v double, u string")
    stored = frame.to_stored_units(F.col("s"), F.col("v"), F.col("u"), F.col("v"))
    got = [r.x for r in df.select("i", stored.alias("x")).orderBy("i").collect()]
    assert [None if x is None else round(x, 9) for x in got] == [0.0, 3600.0, 1.0, 13.25, 13.25, 26.85, 20.0, -253.15, -3.0, None]
    assert df.select(frame.from_stored_units(F.lit("mslp"), F.lit(13.25)).alias("x")).first().x == 1013.25
    with pytest.raises(Exception, match="no such stream or unit"):
        df.select(frame.to_stored_units(F.lit("precip"), F.lit(1.0), F.lit("furlong"), F.lit(None)).alias("x")).collect()


def test_five_vertices_count(spark):
    v = lambda n: [(i,) for i in range(n)]
    lines = spark.createDataFrame([("long", v(13)), ("short", v(4)), ("none", [])], "k string, vertices array<struct<c:long>>")
    ranks = spark.createDataFrame([(1, 9), (3, 2), (6, 1)], "c long, rank int")
    assert {r.k: r["rank"] for r in snapping.max_rank(lines, ranks, "k", ["c"]).collect()} == {"long": 2, "short": 9, "none": 0}
