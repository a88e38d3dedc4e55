"""Reading attribute tables, series and products; checked writes and resumption."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.operators.zonal import from_nan


def read_attribute_tables(spark: SparkSession, groups: list[list[str]], aliases: tuple[str, ...] = ("gauge_id", "basin"), numeric: bool = False) -> DataFrame:
    """CSV attribute tables: those of a group side by side by their key, the groups below each other.

    The key is the first alias that a table has; a key that occurs twice in a table, or a column in two tables of a
    group, is an error. With numeric, columns whose values are all numbers become doubles, NaN missing.
    """
    stacked = []
    for paths in groups:
        wide, seen = None, {"basin"}
        for path in paths:
            df = spark.read.csv(path, header=True)
            key = next((a for a in aliases if a in df.columns), None)
            if key is None:
                raise ValueError(f"{path} has none of the keys {aliases}")
            if twice := seen & (set(df.columns) - {key}):
                raise ValueError(f"{path} repeats the columns {sorted(twice)}")
            df = df.withColumnRenamed(key, "basin")
            if not df.groupBy("basin").count().where("count > 1").isEmpty():
                raise ValueError(f"{path} repeats a key")
            seen.update(df.columns)
            wide = df if wide is None else wide.join(df, "basin", "full")
        stacked.append(wide)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    return _numbers(out, "basin") if numeric else out


def _numbers(df: DataFrame, key: str) -> DataFrame:
    """Text columns whose values are all numbers as doubles; one pass counts what isn't."""
    names = [c for c in df.columns if c != key]
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    odd = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & number(c).isNull()).alias(str(i)) for i, c in enumerate(names)]).first()
    return df.select(key, *[(from_nan(number(c)) if odd[i] == 0 else F.col(f"`{c}`")).alias(c) for i, c in enumerate(names)])


def read_series_folder(spark: SparkSession, glob: str, schema: str, t: str = "date") -> DataFrame:
    """One CSV file for each basin, whose name without ending is the basin."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    df = spark.read.csv(glob, header=True, schema=schema)
    return df.select(name.alias("basin"), F.col(t).cast("date").alias("date"), *[c for c in df.columns if c != t])


def read_product(spark: SparkSession, path: str, bands: list[str], basins: list | None = None, leads: tuple[int, int] | None = None, dates: tuple[str, str] | None = None) -> DataFrame:
    """A product's bands for some basins, leads and dates; selections and columns reach the scan."""
    df = spark.read.parquet(path)
    if lacking := [b for b in bands if b not in df.columns]:
        raise ValueError(f"the product lacks the bands {lacking}")
    if basins is not None:
        df = df.where(F.col("basin").isin(list(basins)))
    if leads:
        df = df.where(F.col("lead_time").between(*leads))
    if dates:
        df = df.where(F.col("date").between(*[F.to_date(F.lit(d)) for d in dates]))
    kinds = dict(df.dtypes)
    value = lambda b: from_nan(b).alias(b) if kinds[b] in ("double", "float") else F.col(b)
    return df.select(*[c for c in ("basin", "date", "lead_time") if c in df.columns], *map(value, bands))


def resolve_bands(df: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """Each target band from the first of its candidates that the table has, else missing; none at all is an error."""
    found = {band: next((c for c in names if c in df.columns), None) for band, names in candidates.items()}
    if not any(found.values()):
        raise ValueError("the table has none of the bands")
    taken = {c for names in candidates.values() for c in names}
    return df.select(*[c for c in df.columns if c not in taken], *[(F.col(c) if c else F.lit(None).cast("double")).alias(b) for b, c in found.items()])


def normalise_longitude(df: DataFrame, lon: str = "lon") -> DataFrame:
    return df.withColumn(lon, F.when(F.col(lon) >= 180, F.col(lon) - 360).otherwise(F.col(lon)))


def ensure_companions(df: DataFrame, bands: list[str], primary: str, fraction: str) -> DataFrame:
    """Absent bands as missing, and a missing fraction from the primary band if there is none."""
    df = df.withColumns({b: F.lit(None).cast("double") for b in bands if b not in df.columns})
    return df if fraction in df.columns else df.withColumn(fraction, F.when(F.col(primary).isNull(), 1.0).otherwise(0.0))


def ingest_flow(df: DataFrame, aliases: dict[str, list[str]], sentinels: tuple[str, ...] = ("-999", "-9999", "NaN", "NA", "")) -> DataFrame:
    """Text columns to (date, q): aliases of the names, strict dates, sentinels and negatives as missing, the largest value of a repeated date, with its number of rows."""
    names = {k: next((c for c in df.columns if c.lower() in v), None) for k, v in aliases.items()}
    if None in names.values():
        raise ValueError(f"no column for {[k for k, v in names.items() if v is None]}")
    text = F.trim(names["q"])
    q = F.when(~text.isin(*sentinels), text.try_cast("double"))
    day = F.when(F.col(names["date"]).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(names["date"]).try_cast("date"))
    out = df.select(day.alias("date"), F.when(q >= 0, q).alias("q")).where("date IS NOT NULL")
    return out.groupBy("date").agg(F.max("q").alias("q"), F.count(F.lit(1)).alias("rows"))


def plan_resume(existing: DataFrame, requested: DataFrame, t: str = "date", value: str = "value") -> DataFrame:
    """The requested days to append. Stored days must have no gap, their last one a valid value, and the first day to append must follow it."""
    gaps = existing.select(t).distinct().withColumn("_b", F.lag(t).over(Window.orderBy(t))).where(F.datediff(t, "_b") > 1)  # a row for each day
    if not gaps.isEmpty():
        raise ValueError("the stored days have a gap")
    last = existing.groupBy(t).agg(F.count(value).alias("_n")).orderBy(F.col(t).desc()).limit(1).where("_n = 0")
    if not last.isEmpty():
        raise ValueError("the last stored day is all missing")
    new = requested.join(existing.select(t).distinct(), t, "left_anti")
    end = existing.agg(F.max(t)).first()[0]
    new = new.where(F.col(t) > F.lit(end)) if end is not None else new
    first = new.agg(F.min(t)).first()[0]
    if end is not None and first is not None and (first - end).days != 1:
        raise ValueError(f"{first} doesn't follow the last stored day, {end}")
    return new


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_product(df: DataFrame, path: str, bands: list[str], max_lead: int | None = None, allow_both: bool = False, files: int = 1) -> DataFrame:
    """Appends a product's rows below path, a folder for each date; a table that isn't there yet is begun.

    Bands must be there; leads lie in 1..max_lead. New basins and new dates at once need allow_both. Dates that
    are rewritten replace their folders, each written by `files` tasks; the written rows come back.
    """
    if lacking := [c for c in ["basin", "date", *bands] if c not in df.columns]:
        raise ValueError(f"the rows lack {lacking}")
    if max_lead is not None and not df.where(~F.col("lead_time").between(1, max_lead)).isEmpty():
        raise ValueError("a lead is out of range")
    spark = df.sparkSession
    old = None if allow_both else _stored(spark, path)
    if old is not None:
        new_basins = df.select("basin").distinct().join(old.select("basin").distinct(), "basin", "left_anti")
        new_dates = df.select("date").distinct().join(old.select("date").distinct(), "date", "left_anti")
        if not new_basins.isEmpty() and not new_dates.isEmpty():
            raise ValueError("new basins and new dates at once")
    dealt = df.repartition("date") if files == 1 else df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "date", F.pmod(F.xxhash64("basin"), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    return spark.read.parquet(path)
