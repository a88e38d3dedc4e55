"""What the operators of this subpackage share: tables, the shared folder, gapless positions, word splitting."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but these six ASCII separators; Unicode spaces belong to words.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only below this many rows (narrow rows of ids and numbers).
BROADCAST_ROWS = 500_000


def fields(spec: str) -> T.StructType:
    """A schema from "name type, ..." with simple types; unlike a DDL string it needs no session."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    kinds |= {f"array<{k}>": T.ArrayType(v) for k, v in kinds.items()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (x.split() for x in spec.split(","))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master without one a folder of our own (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not str(spark.conf.get("spark.master", "local")).startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        base = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in what goes to Python at once: documents can be long, and workers keep what they once took."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it and don't depend on the executors that made it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame, without: tuple[str, ...] = ()):
    """All columns as one named `row`, so that what an operator adds can't clash with them; names in `without`, in any case, are left out."""
    kept = [c for c in df.columns if c.lower() not in without]
    return F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")


def hex_number(column, start: int, digits: int):
    """The given hex digits of a hash (1-based start) as a bigint."""
    return F.conv(F.substring(column, start, digits), 16, 10).cast("bigint")


def planes(values: np.ndarray, width: int) -> bytes:
    """Whole numbers byte by byte: all first bytes, then all second ones; they shrink better so."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def gapless(df: DataFrame, groups: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within each group of `groups`, by bucket and then `order`.

    No task sees a whole group: rows are ranked within (group, bucket), and what precedes a bucket comes from
    the table of counts. Groups times buckets are bounded by the caller's parameters, so that table is broadcast.
    """
    keys = [*groups, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return (
        ranked.join(F.broadcast(offsets), keys)
        .withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("bigint"))
        .drop("_rank", "_before")
    )


def crc32_sql(hex_text: str) -> str:
    """SQL for the CRC-32 of bytes given as hex digits, by a table of what each byte adds."""
    table_ = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        table_.append(c)
    byte = f"('0x' || substr({hex_text}, 2 * i + 1, 2))::BIGINT"
    each = f"list_concat([4294967295], list_transform(range(length({hex_text}) // 2), lambda i: {byte}))"
    return f"xor(list_reduce({each}, lambda a, x: xor(a >> 8, ({table_}::BIGINT[])[xor(a, x) % 256 + 1])), 4294967295)::BIGINT"
