"""Guarded appends, completeness and corrections over restarts, replays and late rows; draws of mixtures."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import mixture
from freshet.operators import frame
from freshet.streaming import guards

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
FLOWS = "k string, d date, q double"


def days(spark, *rows):
    return spark.createDataFrame([(k, DAY(n), v) for k, n, v in rows], FLOWS)


def add_file(df, path, n):
    df.coalesce(1).write.mode("append").parquet(str(path))
    for name in os.listdir(path):
        if name.endswith(".parquet") and os.path.getmtime(path / name) > 1e9:
            os.utime(path / name, (1000 + n, 1000 + n))


def run(stream, ck, mode="append", sink=None):
    """Runs until all files are read; without a sink the rows come back."""
    got = []
    own = sink or (lambda batch, n: got.extend(batch.collect()))
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(ck)).trigger(availableNow=True).foreachBatch(own).start()
    q.awaitTermination(180)
    if q.exception():
        raise q.exception()
    return got


def totals(state, new):
    mine = new.groupBy("k").agg(F.sum("q").alias("total"))
    return mine if state is None else state.unionByName(mine).groupBy("k").agg(F.sum("total").alias("total"))


def test_appends_are_committed_once(spark, tmp_path):
    path = str(tmp_path / "t")
    commit = guards.guarded_append(path, "k", "d", "q", update=totals)
    first = days(spark, ("a", 0, 1.0), ("b", 0, 2.0), ("a", 1, 3.0), ("b", 1, None))
    commit(first, 0)
    commit(first, 0)  # a replay
    assert guards.read_committed(spark, path).count() == 4
    commit(days(spark, ("a", 1, 99.0), ("a", 2, 4.0)), 1)  # the stored day is passed over
    state = {r.k: (r.as_of, r.total) for r in guards.hand_off(spark, path).collect()}
    assert state == {"a": (DAY(2), 8.0), "b": (DAY(0), 2.0)}
    assert guards.hand_off_date(guards.hand_off(spark, path)) == DAY(0)
    for bad in (days(spark, ("a", 4, 1.0)), days(spark, ("a", 3, 1.0), ("a", 5, 1.0)), days(spark, ("a", 3, 1.0), ("a", 4, None))):
        with pytest.raises(guards.GapError):
            commit(bad, 2)
    assert guards.committed_version(spark, path) == 1 and guards.read_committed(spark, path).count() == 5
    commit(days(spark, ("a", 0, 7.0)), 2)  # nothing new
    commit(days(spark, ("a", 3, 1.0), ("b", 3, 5.0)), 3)
    assert {r.k: (r.as_of, r.total) for r in guards.hand_off(spark, path).collect()} == {"a": (DAY(3), 9.0), "b": (DAY(3), 7.0)}


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    commit = guards.guarded_append(path, "k", "d", "q")
    commit(days(spark, ("a", 0, 1.0)), 0)
    days(spark, ("a", 1, 5.0), ("a", 2, 6.0)).write.parquet(f"{path}/data/batch=1")  # data without a commit
    assert guards.read_committed(spark, path).count() == 1
    commit(days(spark, ("a", 1, 2.0)), 1)
    assert sorted(r.q for r in guards.read_committed(spark, path).collect()) == [1.0, 2.0]


def test_old_data_stops_the_stream(spark, tmp_path):
    late = guards.guarded_append(str(tmp_path / "t"), "k", "d", "q", max_lag_days=7, today=lambda: DAY(30))
    with pytest.raises(guards.GapError):
        late(days(spark, ("a", 0, 1.0)), 0)
    late(days(spark, ("a", 23, 1.0)), 0)


def test_a_gap_stops_a_running_stream_and_a_restart_goes_on(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "t")
    for n, rows in enumerate([[("a", 0, 1.0)], [("a", 1, 2.0)], [("a", 3, 4.0)]]):
        add_file(days(spark, *rows), source, n)
    stream = spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 1).parquet(str(source))
    commit = guards.guarded_append(path, "k", "d", "q")
    with pytest.raises(Exception, match="without a gap"):
        run(stream, tmp_path / "ck", sink=commit)
    assert guards.committed_version(spark, path) == 1
    days(spark, ("a", 2, 3.0)).write.parquet(str(tmp_path / "late"))
    filled = lambda batch, n: commit(batch.unionByName(batch.sparkSession.read.parquet(str(tmp_path / "late"))), n)
    run(stream, tmp_path / "ck", sink=filled)
    assert sorted(r.q for r in guards.read_committed(spark, path).collect()) == [1.0, 2.0, 3.0, 4.0]


def test_monitor_agrees_with_the_batch_rule(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "m")
    cohort = spark.createDataFrame([("p", k) for k in "abc"] + [("r", "z")], "product string, k string")
    batches = [[("a", 0, 1.0), ("b", 0, 1.0)], [("c", 0, 1.0), ("a", 1, 1.0), ("a", 1, 2.0), ("x", 1, 1.0)], [("b", 2, 1.0), ("a", 2, 1.0), ("c", 2, None)], [("c", 2, 3.0), ("b", 1, 1.0)]]
    schema = "product string, k string, ts timestamp, q double"
    rows = [[("p", k, dt.datetime(2024, 1, 1 + n), v) for k, n, v in b] for b in batches]
    for n, b in enumerate(rows):
        add_file(spark.createDataFrame(b, schema), source, n)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    found = guards.completeness(stream, cohort, "product", "k", "ts", "q", "10 days")
    run(found, tmp_path / "ck", "update", guards.last_valid_monitor(path, cohort, "product", "k", "ts"))
    got = {r["product"]: r.last_valid for r in guards.last_valid(spark, path, "product").collect()}
    both = spark.createDataFrame([r for b in rows for r in b], schema).join(cohort, ["product", "k"], "left_semi")
    assert got == {"p": frame.last_valid_date(both, "k", "ts", "q").first().last_valid.date()} == {"p": DAY(2)}
    history = {r.version: r.last_valid for r in spark.read.parquet(path).collect()}
    assert [history[v] for v in sorted(history)][:1] == [DAY(0)] and sorted(history.values())[-1] == DAY(2)


def test_nudges_wait_for_late_rows_and_survive_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    schema = "k string, ts timestamp, obs double, base double"
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    def put(n, *rows):
        add_file(spark.createDataFrame([(k, at(d), o, b) for k, d, o, b in rows], schema), source, n)

    put(0, ("a", 0, 10.0, 8.0), ("a", 2, 12.0, 8.0), ("b", 2, None, 1.0))
    put(1, ("a", 1, 9.0, 9.0))  # late, but before the watermark
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = guards.nudges(stream, "k", "ts", "obs", "base", "3 days", window=3, horizon=2)
    assert run(out, tmp_path / "ck") == []
    put(2, ("b", 20, 5.0, 4.0))  # the watermark passes a's anchor
    put(3, ("b", 21, None, 4.0), ("a", 1, 500.0, 0.0))  # too late
    got = run(out, tmp_path / "ck")
    a = sorted((r.lead, r.date.day, r["shift"]) for r in got if r[0] == "a")
    assert [(k, day) for k, day, _ in a] == [(1, 4), (2, 5)]
    np.testing.assert_allclose([s for *_, s in a], [0.8 * 0.9 * 2, 0.8 * 0.81 * 2])
    put(4, ("a", 21, 3.0, 2.0), ("b", 40, 1.0, 1.0))
    put(5, ("b", 41, 1.0, 1.0))
    later = run(out, tmp_path / "ck")
    np.testing.assert_allclose([r["shift"] for r in later if r[0] == "a" and r.lead == 1], [0.8 * 0.9 * 1.0])  # old residuals are gone
    assert not [r for r in later if r[0] == "b"]  # a later anchor took the place of the one that had not come out


def mixtures(spark):
    c = F.array(F.struct(F.lit(1.0).alias("mu"), F.lit(2.0).alias("b"), F.lit(0.3).alias("tau"), F.lit(0.7).alias("pi")), F.struct(F.lit(6.0).alias("mu"), F.lit(1.0).alias("b"), F.lit(0.6).alias("tau"), F.lit(0.3).alias("pi")))
    return spark.range(40).withColumn("c", c).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(999))))


def test_draws_follow_the_mixture(spark):
    df = mixtures(spark)
    draws = df.select("id", "draw", mixture.mixture_sample(F.col("c"), F.col("id"), F.col("draw")).alias("v"), mixture.mixture_mean(F.col("c")).alias("mean"), "c")
    draws = draws.withColumn("at", mixture.mixture_cdf(F.col("c"), F.col("v"))).drop("c")
    r = draws.agg(F.avg("v").alias("v"), F.first("mean").alias("mean"), *[F.avg((F.col("at") < q / 10).cast("int")).alias(f"q{q}") for q in (1, 5, 9)]).first()
    assert r.v == pytest.approx(r["mean"], rel=0.02)
    assert [r.q1, r.q5, r.q9] == pytest.approx([0.1, 0.5, 0.9], abs=0.01)
    again = df.repartition(7).select("id", "draw", mixture.mixture_sample(F.col("c"), F.col("id"), F.col("draw")).alias("w"))
    assert draws.join(again, ["id", "draw"]).where("v <> w").count() == 0
    other = df.select("id", "draw", mixture.mixture_sample(F.col("c"), F.col("id"), F.col("draw"), seed="1").alias("w"))
    assert draws.join(other, ["id", "draw"]).where("v = w").count() == 0


def test_negative_draws(spark):
    df = mixtures(spark).where("id < 4")
    of = lambda how, **k: mixture.mixture_sample(F.col("c"), F.col("id"), F.col("draw"), negatives=how, zero=0.5, **k)
    r = df.select(of("none").alias("n"), of("clip").alias("clip"), of("truncate").alias("t"), of("truncate", retries=0).alias("u")).toPandas()
    assert (r.n < 0.5).any() and (r["clip"] >= 0.5).all() and (r["clip"][r.n >= 0.5] == r.n[r.n >= 0.5]).all() and (r.t[r.n >= 0.5] == r.n[r.n >= 0.5]).all()
    assert (r.u == r.n).all() and (r.t < 0.5).sum() < (r.n < 0.5).sum() / 4
    none = spark.range(1).withColumn("c", F.array(F.struct(F.lit(1.0).alias("mu"), F.lit(2.0).alias("b"), F.lit(0.3).alias("tau"), F.lit(0.0).alias("pi"))))
    assert none.select(mixture.mixture_sample(F.col("c"), F.col("id"), F.lit(0)).alias("v")).first().v is None
    with pytest.raises(ValueError):
        mixture.mixture_sample(F.col("c"), F.col("id"), F.col("draw"), negatives="other")
