"""Sharding by rendezvous hashing: each record goes to the shard with the best weighted score for its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import crc32_sql, gapless, hex_number, table

SHARDS = 16
SEED = "shard"
#: Sub-buckets of a shard within which slots are ranked; shards x BUCKETS rows of counts are broadcast.
BUCKETS = 256


def rendezvous(key: Column, weights: list[float], seed: str = SEED) -> Column:
    """Index of the shard with the least -ln(u) / weight, u a uniform hash of key and shard.

    A shard's score doesn't depend on the other shards: a new shard only takes rows, a removed one only gives
    them, and a changed weight moves rows only to or from its own shard. An MD5 of (seed, key, block) gives the
    uniforms of four shards. A null key counts as an empty one. Ties go to the lower index.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for i, w in enumerate(weights):
        digest = F.md5(F.concat(F.lit(f"{seed}:{i // 4}:"), text))
        u = (hex_number(digest, 1 + 8 * (i % 4), 8) + F.lit(0.5)) / F.lit(4294967296.0)
        scores.append(-F.log(u) / F.lit(float(w)))
    return F.array_position(F.array(*scores), F.array_min(F.array(*scores))).cast("int") - 1


def assign_shards(df: DataFrame, key: str, weights: list[float], seed: str = SEED, shard: str = "shard") -> DataFrame:
    """df with the column `shard`; no shuffle. Repeated rows have equal keys and so share a shard."""
    return df.withColumn(shard, rendezvous(F.col(key), weights, seed))


def with_slots(df: DataFrame, key: str, shard: str = "shard", slot: str = "slot", buckets: int = BUCKETS) -> DataFrame:
    """Adds each row's gapless position in its shard, from 0, without bringing a shard to one task."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return gapless(
        df.withColumn("_bucket", hex_number(F.md5(F.concat(F.lit("slot:"), text)), 1, 8) % buckets),
        [shard], "_bucket", [F.col(key).asc_nulls_first()], slot,
    ).drop("_bucket")


def write_shards(df: DataFrame, path: str, key: str, weights: list[float], seed: str = SEED) -> None:
    """Writes one folder for each shard, each from several tasks."""
    placed = assign_shards(df, key, weights, seed)
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(8))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `key`, and where they would be with a shard more.

    Null and empty texts have size 1 and the CRC of no bytes, very long ones are read whole; rows that repeat a doc_id share its
    shard with slots of their own, in any order; a null doc_id counts as an empty one. Other columns aren't read. An empty table gives no rows.
    """
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32")
    )
    placed = assign_shards(docs, "doc_id", [1.0] * SHARDS)
    grown = assign_shards(placed, "doc_id", [1.0] * (SHARDS + 1), shard="grown_shard")
    return with_slots(grown, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _op6_sql() -> str:
    uniform = lambda i: f"(('0x' || substr(m{i // 4}, {1 + 8 * (i % 4)}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"
    scores = ", ".join(f"-ln({uniform(i)})" for i in range(SHARDS + 1))
    digests = ", ".join(f"md5('{SEED}:{k}:' || coalesce(doc_id::VARCHAR, '')) AS m{k}" for k in range(SHARDS // 4 + 1))
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, {digests} FROM documents),
s AS MATERIALIZED (SELECT doc_id, h, [{scores}] AS s FROM d),
p AS (SELECT doc_id, h, (list_position(s[1:{SHARDS}], list_min(s[1:{SHARDS}])) - 1)::INT AS shard, (list_position(s, list_min(s)) - 1)::INT AS grown_shard FROM s)
SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size,
{crc32_sql("h")} AS text_crc32,
'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {BUCKETS}, doc_id NULLS FIRST) - 1 AS slot, grown_shard FROM p
"""


OP6_SQL = _op6_sql()
