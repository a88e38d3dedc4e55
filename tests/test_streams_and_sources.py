"""Streams give what the batch operators give; sources and sinks check what they read and write."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from freshet.operators import climate, frame
from freshet.sources import tables
from freshet.streaming import jobs


def drained(stream, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(q.name).collect()


@pytest.fixture
def frames(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(minutes=30 * i), 1.0) for i in range(48)] + [("a", start + dt.timedelta(days=1, minutes=30 * i), 2.0) for i in range(40)]
    rows += [("a", start + dt.timedelta(days=9), 0.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_days_come_out_complete(frames, tmp_path):
    got = {r["date"]: (r["total"], r["slots"]) for r in drained(jobs.daily_complete(frames, "k", "ts", "v", "1 day"), tmp_path)}
    assert got == {dt.date(2024, 1, 1): (48.0, 48), dt.date(2024, 1, 2): (None, 40)}


def test_bins_and_sessions(frames, tmp_path):
    assert len(drained(jobs.three_hour_bins(frames, "k", "ts", "v", "1 hour"), tmp_path / "b")) == 15
    got = drained(jobs.wet_sessions(frames, "k", "ts", "v", 0.5, "1 hour"), tmp_path / "s")
    assert [(r["n"], r["peak"]) for r in got] in ([(88, 2.0)], [])  # comes out when the watermark passes it


def test_alerts_keep_the_last_value(spark, tmp_path):
    rows = [[("a", 1, 1.0), ("a", 2, 6.0)], [("a", 3, 7.0), ("a", 4, 2.0)], [("a", 5, None), ("a", 6, 8.0), ("a", 2, 9.0)]]
    for i, batch in enumerate(rows):
        spark.createDataFrame([(k, dt.datetime(2024, 1, d), v) for k, d, v in batch], "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(tmp_path / "in", (i, i))
    stream = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(jobs.threshold_alerts(stream, "k", "ts", "v", 5.0), tmp_path)
    assert sorted((r["ts"].day, r["v"]) for r in got) == [(2, 6.0), (6, 8.0)]


def test_alerts_of_keys_without_values(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1), None), ("b", dt.datetime(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert drained(jobs.threshold_alerts(stream, "k", "ts", "v", 5.0), tmp_path) == []


def test_upsert_best(spark, tmp_path):
    merge = jobs.upsert_best(str(tmp_path / "t"), ["k"], "v", "f")
    merge(spark.createDataFrame([(1, 1.0, 0.5), (2, None, None)], "k int, v double, f double"), 0)
    merge(spark.createDataFrame([(1, 2.0, 0.6), (2, 3.0, 0.1), (2, 4.0, 0.2), (3, 5.0, 0.0)], "k int, v double, f double"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/1")).collect())) == [(1, 1.0, 0.5), (2, 3.0, 0.1), (3, 5.0, 0.0)]


def test_attribute_tables(spark, tmp_path):
    for name, text in (("a", "gauge_id,area\nx,1\ny,2\n"), ("b", "basin,slope\nx,3\n"), ("c", "gauge_id,area\nz,9\n"), ("d", "gauge_id,area\nx,1\nx,2\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    p = lambda n: str(tmp_path / f"{n}.csv")
    got = tables.read_attribute_tables(spark, [[p("a"), p("b")], [p("c")]]).orderBy("basin").collect()
    assert [(r["basin"], r["area"], r["slope"]) for r in got] == [("x", "1", "3"), ("y", "2", None), ("z", "9", None)]
    for bad in ([[p("d")]], [[p("a"), p("c")]]):
        with pytest.raises(ValueError):
            tables.read_attribute_tables(spark, bad)


def test_series_folder_and_flow_text(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/b1.csv").write_text("date,q\n2020-01-01,1.5\n")
    (tmp_path / "s/b2.csv").write_text("date,q\n2020-01-01,2.5\n")
    got = tables.read_series_folder(spark, str(tmp_path / "s/*.csv"), "date string, q double").orderBy("basin").collect()
    assert [(r["basin"], r["q"]) for r in got] == [("b1", 1.5), ("b2", 2.5)]
    raw = spark.createDataFrame([("2020-01-01", "1"), ("2020-01-02", "-999"), ("2020-01-03", "-4"), ("2020-1-4", "5"), ("2020-01-05", "x"), ("2020-01-01", "2")], "Day string, Flow string")
    got = {str(r["date"]): (r["q"], r["rows"]) for r in tables.ingest_flow(raw, {"date": ["day", "date"], "q": ["flow"]}).collect()}
    assert got == {"2020-01-01": (2.0, 2), "2020-01-02": (None, 1), "2020-01-03": (None, 1), "2020-01-05": (None, 1)}


def test_products_are_checked_and_appended(spark, tmp_path):
    path = str(tmp_path / "p")
    day = lambda n, b, v=1.0: spark.createDataFrame([(b, dt.date(2020, 1, n), 1, v)], "basin string, date date, lead_time int, rain double")
    tables.write_product(day(1, "x"), path, ["rain"], 10)
    assert tables.write_product(day(2, "x"), path, ["rain"], 10).count() == 2
    assert tables.write_product(day(2, "x", 5.0), path, ["rain"], 10).where("rain = 5").count() == 1
    for bad, bands, lead in ((day(3, "new"), ["rain"], 10), (day(3, "x"), ["snow"], 10), (day(3, "x"), ["rain"], 0)):
        with pytest.raises(ValueError):
            tables.write_product(bad, path, bands, lead)
    assert tables.read_product(spark, path, ["rain"], ["x"], (1, 1), ("2020-01-02", "2020-01-09")).count() == 1
    stored = spark.createDataFrame([(dt.date(2020, 1, d), 1.0) for d in (1, 2)], "date date, value double")
    wanted = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (2, 3, 4)], "date date")
    assert sorted(r["date"].day for r in tables.plan_resume(stored, wanted).collect()) == [3, 4]
    with pytest.raises(ValueError):
        tables.plan_resume(stored.union(spark.createDataFrame([(dt.date(2020, 1, 9), 1.0)], stored.schema)), wanted)


def test_bands(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "basin int, tp double, lon double")
    got = tables.resolve_bands(df, {"rain": ["precip", "tp"], "snow": ["sf"]}).first()
    assert got["rain"] == 2.0 and got["snow"] is None
    assert tables.ensure_companions(df, ["snow"], "tp", "missing").first()["missing"] == 0.0
    assert spark.createDataFrame([(200.0,)], "lon double").transform(tables.normalise_longitude).first()["lon"] == -160.0
    with pytest.raises(ValueError):
        tables.resolve_bands(df, {"snow": ["sf"]})


def test_lead_days_need_whole_tiles(spark):
    rows = [("a", h, 1.0) for h in (6, 12, 24, 30, 48, 60)] + [("b", h, 2.0) for h in (20, 30, 48)]
    df = spark.createDataFrame(rows, "k string, h int, v double")
    got = sorted((r["k"], r["lead_day"], r["v"]) for r in climate.daily_lead_aggregate(df, ["k"], "h", "v", "rate_sum").collect())
    assert got == [("a", 1, 24.0), ("a", 2, 24.0)]


def test_windows_at_the_edges(spark):
    df = spark.createDataFrame([(1, d, True) for d in range(5)], "k int, t int, ok boolean")
    got = [r[0] for r in df.select(frame.sequence_valid(F.col("ok"), "k", "t", 3, 1).alias("x"), "t").orderBy("t").select("x").collect()]
    assert got == [False, True, True, True, False]
