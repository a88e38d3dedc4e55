"""Streams that commit to tables: gap-free appends with a state to go on from, completeness of products, late corrections."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


# --- gap-free appends ------------------------------------------------------------------------------------------


class GapError(ValueError):
    """What came doesn't follow what is stored."""


def committed_version(spark: SparkSession, path: str) -> int | None:
    """The number of the last batch whose state was committed; its data was written before."""
    versions = _table(spark, f"{path}/commits")
    return None if versions is None else versions.agg(F.max("version")).first()[0]


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed batches: data of a batch that broke off isn't read."""
    last = committed_version(spark, path)
    if last is None:
        raise ValueError("nothing is committed")
    return spark.read.parquet(f"{path}/data").where(F.col("batch") <= last)


def hand_off(spark: SparkSession, path: str) -> DataFrame:
    """The state of every key after the last committed batch, with as_of, its last day with a value."""
    last = committed_version(spark, path)
    if last is None:
        raise ValueError("nothing is committed")
    return spark.read.parquet(f"{path}/state").where(F.col("version") == last).drop("version")


def hand_off_date(state: DataFrame):
    """The day to go on from: the earliest of all keys', so that none is missed; None without a state."""
    return state.agg(F.min("as_of")).first()[0]


def guarded_append(path: str, key: str, t: str, value: str, max_lag_days: int | None = None, today: Callable[[], object] | None = None,
                   update: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None):
    """A foreachBatch function that appends whole days below path and commits each batch once.

    A batch's new days must follow the last stored day without a gap, its last day must have a value, and with
    max_lag_days that day may lie at most so far behind today(); otherwise GapError stops the stream before anything is
    written. Days that are stored already are passed over. The batch's rows are written first, then the state of every key
    (as_of, and what update(state or None, new rows) makes of it), then a commit row of a few numbers. A batch that
    is repeated after its commit changes nothing; one that broke off before is written again.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = committed_version(spark, path)
        if last is not None and number <= last:
            return
        commits = _table(spark, f"{path}/commits")
        end = None if commits is None else commits.agg(F.max("last_day")).first()[0]
        new = (batch if end is None else batch.where(F.col(t) > F.lit(end))).persist()
        try:
            days = new.groupBy(t).agg(F.count(value).alias("_n"))
            seen = days.agg(F.min(t).alias("a"), F.max(t).alias("b"), F.count(F.lit(1)).alias("days"), F.max_by("_n", t).alias("valid")).first()
            if not seen.days:
                _write_state(spark, path, number, None if last is None else hand_off(spark, path))
                _commit(spark, path, number, end, 0)
                return
            if (seen.b - seen.a).days + 1 != seen.days or (end is not None and (seen.a - end).days != 1):
                raise GapError(f"{seen.days} days from {seen.a} to {seen.b} don't follow {end} without a gap")
            if not seen.valid:
                raise GapError(f"{seen.b} has no value at all")
            if max_lag_days is not None and (today() - seen.b).days > max_lag_days:
                raise GapError(f"{seen.b} lies more than {max_lag_days} days back")
            new.drop("batch").write.mode("overwrite").parquet(f"{path}/data/batch={number}")
            old = None if last is None else hand_off(spark, path)
            mine = new.where(F.col(value).isNotNull()).groupBy(key).agg(F.max(t).alias("as_of"))
            if old is not None:
                mine = old.select(key, "as_of").unionByName(mine).groupBy(key).agg(F.max("as_of").alias("as_of"))
            if update is not None:
                mine = mine.join(update(None if old is None else old.drop("as_of"), new), key, "left")
            _write_state(spark, path, number, mine)
            _commit(spark, path, number, seen.b, seen.days)
        finally:
            new.unpersist()

    return commit


def _write_state(spark: SparkSession, path: str, number: int, state: DataFrame | None) -> None:
    if state is not None:
        state.write.mode("overwrite").parquet(f"{path}/state/version={number}")


def _commit(spark: SparkSession, path: str, number: int, last_day, days: int) -> None:
    row = spark.createDataFrame([(number, last_day, days)], T.StructType([T.StructField("number", T.LongType()), T.StructField("last_day", T.DateType()), T.StructField("days", T.LongType())]))
    row.write.mode("overwrite").parquet(f"{path}/commits/version={number}")


# --- completeness ----------------------------------------------------------------------------------------------


def completeness(stream: DataFrame, cohort: DataFrame, product: str, key: str, t: str, value: str, watermark: str) -> DataFrame:
    """(product, t, seen): how many keys of a known cohort (product, key) have a value on each day; for update mode.

    A key counts once however often it comes. Keys outside the cohort don't count. State of days behind the watermark goes.
    """
    mine = stream.where(F.col(value).isNotNull()).join(F.broadcast(cohort.select(product, key).distinct()), [product, key], "left_semi")
    once = mine.withWatermark(t, watermark).dropDuplicates([product, key, t])
    return once.groupBy(product, t).agg(F.count(F.lit(1)).alias("seen"))


def last_valid_monitor(path: str, cohort: DataFrame, product: str, key: str, t: str):
    """A foreachBatch function for `completeness`: keeps versions of (product, last_valid), the latest day on which all of the cohort had values.

    A day never leaves once it was complete, so a repeated batch gives the same version again.
    """

    def follow(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sizes = cohort.select(product, key).distinct().groupBy(product).agg(F.count(F.lit(1)).alias("_size"))
        whole = batch.join(sizes, product).where(F.col("seen") >= F.col("_size")).groupBy(product).agg(F.max(F.to_date(t)).alias("last_valid"))
        old = _table(spark, path)
        if old is not None:
            before = old.where(F.col("version") < number).groupBy(product).agg(F.max("last_valid").alias("last_valid"))
            whole = whole.unionByName(before).groupBy(product).agg(F.max("last_valid").alias("last_valid"))
        whole.write.mode("overwrite").parquet(f"{path}/version={number}")

    return follow


def last_valid(spark: SparkSession, path: str, product: str) -> DataFrame:
    """(product, last_valid) as of now."""
    return spark.read.parquet(path).groupBy(product).agg(F.max("last_valid").alias("last_valid"))


# --- corrections of forecasts ----------------------------------------------------------------------------------


def nudges(stream: DataFrame, key: str, t: str, obs: str, base: str, watermark: str, window: int = 30, share: float = 0.8, keep: float = 0.9, horizon: int = 7) -> DataFrame:
    """(key, anchor, lead, date, shift): what to add to a forecast `lead` days after the last day that has both obs and base.

    The state is that day and the residuals of the last `window` days before it, replaced when a day comes again and let go when they
    are too old, so it never grows. Corrections come out when the watermark passes the anchor, after rows that were late
    for it: the mean residual, times share and keep to the power of the lead. A later anchor sets the timer again.
    """
    kinds = dict(stream.dtypes)
    day_ns = 86_400_000_000_000
    out_names = [key, "anchor", "lead", "date", "shift"]

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        days, residuals, told = json.loads(state.get[0]) if state.exists else ([], [], None)
        held, passed = dict(zip(days, residuals)), state.getCurrentWatermarkMs()
        for rows in frames if not state.hasTimedOut else ():
            good = rows[rows[obs].notna() & rows[base].notna()]
            for when, o, b in zip(good[t], good[obs], good[base]):
                ns = pd.Timestamp(when).value
                if ns // 1_000_000 > passed:  # rows behind the watermark come too late
                    held[ns // day_ns] = float(o) - float(b)
        anchor = max(held, default=None)
        held = {d: r for d, r in held.items() if d > anchor - window}
        out = []
        if held and anchor != told:
            due = (anchor + 1) * 86_400_000
            if due <= passed:
                told, at, mean = anchor, pd.Timestamp(anchor * day_ns), sum(held.values()) / len(held)
                out = [(k[0], at, n, at + pd.Timedelta(days=n), share * keep**n * mean) for n in range(1, horizon + 1)]
            else:
                state.setTimeoutTimestamp(due)
        state.update((json.dumps((sorted(held), [held[d] for d in sorted(held)], told)),))  # even without any: a state column of nulls alone can't be sent
        yield pd.DataFrame(out, columns=out_names)

    schema = f"{key} {kinds[key]}, anchor timestamp, lead int, date timestamp, shift double"
    timed = stream.select(key, t, obs, base).withWatermark(t, watermark)
    return timed.groupBy(key).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)
