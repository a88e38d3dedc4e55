"""Structured Streaming forms of the operators for data that arrives late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


#: The state of a key without a valid value; nulls alone can't be sent as a state column.
NOTHING = (-(1 << 63), float("nan"))


def daily_complete(stream: DataFrame, key: str, t: str, value: str, watermark: str, slots: int = 48, slot_minutes: int = 30) -> DataFrame:
    """Days with all their slots: (key, day, total of slot means is left to the caller as sum and count); append mode.

    A day comes out once the watermark has passed it; an incomplete one comes out with a NULL total.
    """
    slot = F.floor((F.hour(t) * 60 + F.minute(t)) / slot_minutes)
    days = stream.withWatermark(t, watermark).groupBy(F.col(key), F.window(t, "1 day").alias("w"))
    seen = days.agg(F.collect_set(F.when(F.col(value).isNotNull(), slot)).alias("_s"), F.sum(value).alias("_t"))  # at most `slots` numbers
    return seen.select(key, F.to_date("w.start").alias("date"), F.when(F.size("_s") == slots, F.col("_t")).alias("total"), F.size("_s").alias("slots"))


def three_hour_bins(stream: DataFrame, key: str, t: str, value: str, watermark: str) -> DataFrame:
    bins = stream.withWatermark(t, watermark).groupBy(F.col(key), F.window(t, "3 hours").alias("w"))
    return bins.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(key, F.col("w.start").alias("start"), "mean", "n")


def wet_sessions(stream: DataFrame, key: str, t: str, value: str, low: float, watermark: str, gap: str = "36 hours") -> DataFrame:
    """Events of values above low, no longer apart than the gap."""
    wet = stream.where(F.col(value) > low).withWatermark(t, watermark).groupBy(F.col(key), F.session_window(t, gap).alias("w"))
    return wet.agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("peak")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")


def threshold_alerts(stream: DataFrame, key: str, t: str, value: str, threshold: float) -> DataFrame:
    """Rows at which a key's series rises to the threshold; the state is the last valid value and its time.

    Rows that are older than the state's time come too late for a crossing and are passed over.
    """
    kinds = dict(stream.dtypes)

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_t, last_v = state.get if state.exists else NOTHING
        rows = pd.concat(list(frames)).sort_values(t)
        out = []
        for when, v in zip(rows[t], rows[value]):
            stamp = pd.Timestamp(when).value
            if pd.isna(v) or stamp <= last_t:
                continue
            if v >= threshold and not last_v >= threshold:
                out.append((k[0], when, float(v)))
            last_t, last_v = stamp, float(v)
        state.update((last_t, last_v))
        yield pd.DataFrame(out, columns=[key, t, value])

    return stream.select(key, t, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {t} {kinds[t]}, {value} double", "t long, v double", "append", GroupStateTimeout.NoTimeout)


def upsert_best(path: str, keys: list[str], value: str, fraction: str):
    """A foreachBatch function that merges late, better-covered rows into versions of a table below path.

    Every batch writes a new version, named by its number, from the one before; a repeated batch writes the same.
    """
    from freshet.operators.frame import merge_best_coverage

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(F.min_by(F.struct(value, fraction), F.coalesce(F.col(fraction), F.lit(2.0))).alias("_b")).select(*keys, f"_b.{value}", f"_b.{fraction}")
        merged = new if number == 0 else merge_best_coverage(spark.read.parquet(f"{path}/{number - 1}"), new, keys, value, fraction)
        merged.write.mode("overwrite").parquet(f"{path}/{number}")

    return merge
