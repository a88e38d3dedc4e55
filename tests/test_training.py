"""Sample masks, windows and filled features on small series; users' metrics, fitters and models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import registries, skill, training
from freshet.operators.training import SampleRules

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
N = None


def series(spark, q, fore=None, top=1.0, alt=None):
    n = len(q)
    rows = [("b", DAY(i), q[i], (alt or q)[i], (fore or [N] * n)[i], top) for i in range(n)]
    return spark.createDataFrame(rows, "k string, d date, q double, alt double, f array<double>, top double")


def days(df, name="valid"):
    return [(r.d - DAY(0)).days for r in df.where(name).orderBy("d").collect()]


def test_hindcasts_end_before_the_issue_day(spark):
    df = series(spark, [1.0, 2.0, N, 4.0, 5.0, 6.0, 7.0])
    assert days(training.sample_masks(df, "k", "d", SampleRules(hindcast=["q"], length=2))) == [1, 4, 5, 6]
    assert days(training.sample_masks(df, "k", "d", SampleRules(hindcast=["q"], length=2, min_lead=1))) == [2, 5, 6]


def test_targets_are_looked_for_ahead(spark):
    df = series(spark, [N, N, 0.0, N, N, N, 7.0])
    rules = SampleRules(target=["q"], predict_last=2, lead_time=2, min_lead=1)
    assert days(training.sample_masks(df, "k", "d", rules)) == [1, 2, 5]
    strict = SampleRules(target=["q"], predict_last=2, lead_time=2, min_lead=1, refuse_zero_targets=True)
    assert days(training.sample_masks(df, "k", "d", strict)) == [1, 5]
    assert len(days(training.sample_masks(df, "k", "d", strict, training=False))) == 7


def test_forecasts_their_overlap_and_dates(spark):
    fore = [[1.0, 2.0], [1.0, N], [N, 2.0], [1.0, 1.0], [2.0, 2.0], N, [1.0, 1.0]]
    df = series(spark, [1.0] * 7, fore)
    whole = SampleRules(forecast=["f"], leads=[1, 2], min_lead=1)
    assert days(training.sample_masks(df, "k", "d", whole)) == [0, 3, 4, 6]
    some = SampleRules(forecast=["f"], leads=[1, 2], min_lead=1, nan_handling="input_replacing")
    assert days(training.sample_masks(df, "k", "d", some)) == [0, 1, 2, 3, 4, 6]
    overlap = SampleRules(forecast=["f"], leads=[1, 2], min_lead=1, overlap=2)
    assert days(training.sample_masks(df, "k", "d", overlap), "forecast_overlap") == [2, 5]
    few = spark.createDataFrame([(DAY(3),), (DAY(99),)], "d date")
    assert days(training.sample_masks(df, "k", "d", whole, few)) == [3]
    none = SampleRules(static=["top"])
    assert days(training.sample_masks(series(spark, [1.0], top=None), "k", "d", none)) == []


@pytest.mark.parametrize("how,wanted", [("none", [3]), ("input_replacing", [0, 1, 3]), ("masked_mean", [0, 1, 3]), ("attention", [0, 1, 3]), ("unioning", [3])])
def test_handling_of_missing_values(spark, how, wanted):
    df = series(spark, [1.0, N, N, 1.0], alt=[N, 1.0, N, 1.0])
    rules = SampleRules(hindcast=["q", "alt"], length=1, nan_handling=how, hindcast_groups=[["q"], ["alt"]])
    assert days(training.sample_masks(df, "k", "d", rules)) == wanted
    one = SampleRules(hindcast=["q", "alt"], length=1, nan_handling="unioning", hindcast_groups=[["q", "alt"]])
    assert days(training.sample_masks(df, "k", "d", one)) == [0, 1, 3]


def test_rules_are_checked():
    for bad in ({}, {"hindcast": ["a"], "hindcast_groups": [["b"]]}, {"hindcast": ["a"], "nan_handling": "x"}, {"forecast": ["a"]}):
        with pytest.raises(ValueError):
            SampleRules(**bad)


def test_samples_have_leads_and_overlap(spark):
    fore = [[10.0 * i, 10.0 * i + 1, 10.0 * i + 2] for i in range(8)]
    df = series(spark, [float(i) for i in range(8)], fore)
    rules = SampleRules(hindcast=["q", "f"], forecast=["f"], target=["q"], static=["top"], leads=[1, 2, 3], length=3, lead_time=3, min_lead=1, overlap=2)
    r = training.build_samples(df, "k", "d", rules).where(F.col("d") == DAY(4)).first()
    assert r.x_q == [1.0, 2.0, 3.0] and r.x_f == [10.0, 20.0, 30.0] and r.f_f == [20.0, 30.0, 40.0, 41.0, 42.0] and r.y_q == [4.0, 5.0, 6.0] and r.top == 1.0
    plain = training.build_samples(df, "k", "d", SampleRules(hindcast=["q"], target=["q"], length=3)).where(F.col("d") == DAY(4)).first()
    assert plain.x_q == plain.y_q == [2.0, 3.0, 4.0]


def test_features_are_filled_by_valid_day(spark):
    fore = [[N, 1.0], [N, N], [5.0, N], N, [7.0, 8.0]]
    df = series(spark, [100.0, N, N, 103.0, N], fore, alt=[N, 1.0, N, N, N])
    out = training.union_features(df, "k", "d", {"f": "q", "q": "f", "alt": "q", "gone": "q", "top": "top"}, [1, 2], ["f"]).orderBy("d").collect()
    assert [r.f for r in out] == [[100.0, 1.0], [N, N], [5.0, 103.0], [103.0, N], [7.0, 8.0]]
    assert [r.q for r in out] == [100.0, N, 5.0, 103.0, 7.0] and [r.alt for r in out] == [100.0, 1.0, N, 103.0, N]
    later = training.union_features(df, "k", "d", {"q": "f"}, [2, 3], ["f"]).orderBy("d").collect()
    assert [r.q for r in later] == [100.0, N, N, 103.0, N]  # the shortest lead is two days: the forecast of the day before
    both = df.withColumn("g", F.array(F.lit(0.5), F.lit(0.6)))
    assert [r.f for r in training.union_features(both, "k", "d", {"f": "g"}, [1, 2], ["f", "g"]).orderBy("d").collect()][:4] == [[0.5, 1.0], [0.5, 0.6], [5.0, 0.6], [0.5, 0.6]]
    with pytest.raises(ValueError):
        training.union_features(df, "k", "d", {"q": "nothing"}, [1], ["f"])


def test_lead_arrays(spark):
    df = spark.createDataFrame([("b", DAY(0), 1, 1.0), ("b", DAY(0), 3, 3.0), ("b", DAY(1), 9, 3.0)], "k string, d date, lead int, v double")
    assert {r.d: r.v for r in training.lead_arrays(df, "k", "d", "lead", ["v"], [1, 2, 3]).collect()} == {DAY(0): [1.0, N, 3.0], DAY(1): [N, N, N]}


# --- registries


def test_registered_metrics_take_part(spark):
    df = spark.createDataFrame([("b", lead, float(i), float(i) + lead) for lead in (1, 2) for i in range(5)], "k string, lead int, obs double, sim double")
    registries.register_metric("bias", lambda o, s: F.avg(F.col(s) - F.col(o)))
    registries.register_metric("worst", series=lambda o, s: float((s - o).abs().max()))
    try:
        got = {r.lead: (r.bias, r.worst) for r in skill.skill_by_lead(df, "k", "lead", ["nse", "bias", "worst"]).collect()}
        assert got == {1: (1.0, 1.0), 2: (2.0, 2.0), None: (1.5, 2.0)}
        assert {r.lead: r.bias for r in skill.skill_by_lead(df, "k", "lead", ["bias"]).collect()} == {1: 1.0, 2: 2.0, None: 1.5}
        assert skill.skill(df, ["k"], ["worst"]).first().worst == 2.0
        with pytest.raises(ValueError):
            registries.register_metric("nse", lambda o, s: F.lit(0))
        with pytest.raises(ValueError):
            registries.register_metric("both")
    finally:
        registries.unregister_metric("bias")
        registries.unregister_metric("worst")
    with pytest.raises(ValueError):
        skill.skill(df, ["k"], ["bias"])


def years(spark, peaks):
    rows = [(k, dt.date(2000 + y, 1, 1) + dt.timedelta(days=i), float(v) if i == 100 else 0.5) for k, vs in peaks.items() for y, v in enumerate(vs) for i in range(0, 365)]
    return spark.createDataFrame(rows, "k string, d date, q double")


def test_registered_fitters_make_thresholds(spark):
    df = years(spark, {"a": [10, 20, 30, 40, 50, 60], "few": [10, 20], "flat": [5, 5, 5, 5, 5]})
    registries.register_fitter("largest", registries.grouped_fitter(lambda peaks, periods: np.full(len(periods), peaks.max()) * periods))
    try:
        got = {(r.k, r.period): r.flow for r in registries.series_thresholds(df, "k", "d", "q", "largest", [2, 10]).collect()}
        assert got == {("a", 2.0): 120.0, ("a", 10.0): 600.0, ("few", 2.0): N, ("few", 10.0): N, ("flat", 2.0): N, ("flat", 10.0): N}
    finally:
        registries.unregister_fitter("largest")
    for name in ("gumbel", "lp3", "loglog", "ema"):
        flows = [r.flow for r in registries.series_thresholds(df.where("k = 'a'"), "k", "d", "q", name, [2, 10, 50]).orderBy("period").collect()]
        assert flows == sorted(flows) and 20 < flows[0] < 50
    with pytest.raises(ValueError):
        registries.series_thresholds(df, "k", "d", "q", "largest", [2])
    with pytest.raises(Exception, match="negative"):
        registries.series_thresholds(df.withColumn("q", -F.col("q")), "k", "d", "q", "gumbel", [2]).collect()


def test_a_users_model_scores_samples(spark):
    df = series(spark, [float(i) for i in range(20)]).repartition(3)
    samples = training.build_samples(df, "k", "d", SampleRules(hindcast=["q"], length=3)).where(F.size("x_q") == 3)
    model = lambda rows: pd.DataFrame({"total": [float(sum(v)) for v in rows["x_q"]], "n": [len(v) for v in rows["x_q"]]})
    got = training.score_samples(samples, model, "total double, n int", ["k", "d"], batch=4).orderBy("d").collect()
    assert [r.total for r in got] == [3.0 * i - 3 for i in range(2, 20)] and {r.n for r in got} == {3}
    with pytest.raises(Exception, match="another number of rows"):
        training.score_samples(samples, lambda rows: pd.DataFrame({"n": [1]}), "n int", ["k"]).collect()
