"""Registration of queries, and domain views of the tables, for Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a query; sql may use the named views, which are put before it."""

    def register(f):
        QUERIES[name] = f
        if sql:
            parts = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
            body = sql.strip()
            for start in ("WITH RECURSIVE ", "WITH "):
                if parts and body.startswith(start):
                    body = f"{start}{parts}, {body[len(start) :]}"
                    break
            else:
                body = f"WITH {parts} {body}" if parts else body
            ORACLE[name] = body
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


VIEWS = {
    "flow": """SELECT s_nationkey AS basin, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS q
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "obs_sim": """SELECT s_nationkey AS basin, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS obs,
        CASE WHEN day(CAST(l_shipdate AS DATE)) % 11 = 0 THEN NULL ELSE SUM(CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT)) / 1984.0::DOUBLE END AS sim
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "forecast": """SELECT s_nationkey AS basin, l_linenumber AS lead, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS obs,
        CASE WHEN day(CAST(l_shipdate AS DATE)) % 11 = 0 THEN NULL ELSE SUM(CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT)) / 1984.0::DOUBLE END AS sim
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
    "grid": """SELECT (l_partkey // 12) % 6 AS lat_idx, l_partkey % 12 AS lon_idx, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, AVG(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2, 3""",
    "weights": """SELECT (lat_idx * 12 + lon_idx) % 8 AS basin, lat_idx, lon_idx, size / SUM(size) OVER (PARTITION BY (lat_idx * 12 + lon_idx) % 8) AS weight
        FROM (SELECT (p_partkey // 12) % 6 AS lat_idx, p_partkey % 12 AS lon_idx, CAST(SUM(p_size) AS DOUBLE) AS size FROM part GROUP BY 1, 2)""",
    "ensemble": """SELECT o_custkey % 25 AS basin, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS member, MAX(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3""",
    "reaches": """SELECT s_suppkey AS reach_id, s_suppkey // 2 AS next_down, s_acctbal + 1000 AS area FROM supplier WHERE s_suppkey > 0""",
    "points": """SELECT c_custkey AS point_id, (c_custkey * 37 % 1800) / 10.0::DOUBLE - 90 AS lat, (c_custkey * 61 % 3600) / 10.0::DOUBLE - 180 AS lon FROM customer""",
    "fragments": """SELECT s_nationkey AS basin, s_suppkey AS sub_id, s_acctbal + 1000 AS overlap, s_suppkey % 5 AS class FROM supplier""",
}


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber", F.to_date("l_shipdate").alias("date"))
    basins = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("basin"))
    return items.join(basins, "l_suppkey")


def _sim():
    return F.when(F.day("date") % 11 == 0, F.lit(None)).otherwise(F.col("money") / 1984.0)


def _money():
    return F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint"))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_day(spark, sf_dir).groupBy("basin", "date").agg(F.sum("l_quantity").alias("q"))


def obs_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _by_day(spark, sf_dir).groupBy("basin", "date").agg(F.sum("l_quantity").alias("obs"), _money().alias("money"))
    return daily.select("basin", "date", "obs", _sim().alias("sim"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _by_day(spark, sf_dir).groupBy("basin", F.col("l_linenumber").alias("lead"), "date").agg(F.sum("l_quantity").alias("obs"), _money().alias("money"))
    return daily.select("basin", "lead", "date", "obs", _sim().alias("sim"))


def _cell(key: str) -> list:
    return [(F.floor(F.col(key) / 12) % 6).alias("lat_idx"), (F.col(key) % 12).alias("lon_idx")]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    return items.groupBy(*_cell("l_partkey"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week")).agg(F.avg("l_quantity").alias("value"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.operators.zonal import normalised_weights

    cells = read(spark, sf_dir, "part").groupBy(*_cell("p_partkey")).agg(F.sum("p_size").cast("double").alias("size"))
    return normalised_weights(cells.withColumn("basin", (F.col("lat_idx") * 12 + F.col("lon_idx")) % 8), "size").select("basin", "lat_idx", "lon_idx", "weight")


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy((F.col("o_custkey") % 25).alias("basin"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("member")).agg(F.max("o_totalprice").alias("value"))


def reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("reach_id"), F.floor(F.col("s_suppkey") / 2).alias("next_down"), (F.col("s_acctbal") + 1000).alias("area"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("point_id"), (k * 37 % 1800 / 10.0 - 90).alias("lat"), (k * 61 % 3600 / 10.0 - 180).alias("lon"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("basin"), F.col("s_suppkey").alias("sub_id"), (F.col("s_acctbal") + 1000).alias("overlap"), (F.col("s_suppkey") % 5).alias("class"))
