"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import BROADCAST_ROWS, gapless, hex_number, table, whole_row, written

SEED = "mix"
#: Share of the mix by language, for op1: English is brought down, the others up.
LANGUAGE_WEIGHTS = {"en": 0.40, "de": 0.25, "fr": 0.20, "es": 0.15}
#: Without given weights a group's weight is its rows to this power: large groups are brought down, small ones up.
TEMPER = 0.7
#: A larger rate is the sum of several Poisson variables of equal rates up to this, which is Poisson again.
RATE_TERM = 16.0
#: Buckets of the global order; this many rows of counts are broadcast whatever the input.
BUCKETS = 4096


def poisson_quantile(u: Column, rate: Column, most: float = RATE_TERM) -> Column:
    """The number of k with u >= P(N <= k), N Poisson with mean rate <= most: the inverse of the distribution at u.

    u has 52 bits, so terms beyond most + 12 sqrt(most) + 20 are never reached; the sum runs that far.
    """
    terms = math.ceil(most + 12 * math.sqrt(most) + 20)
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["n"] + F.when(u >= acc["cdf"], 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)).cast("array<double>"), start, step, lambda acc: acc["n"])


def poisson_count(key: Column, rate: Column, seed: str = SEED) -> Column:
    """A Poisson count with mean `rate` that depends on seed and key alone (a null key counts as an empty one)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    parts = F.greatest(F.lit(1), F.ceil(rate / RATE_TERM)).cast("int")

    def one(k):
        digest = F.md5(F.concat(F.lit(f"{seed}:"), F.when(k > 0, F.concat(k.cast("string"), F.lit(":"))).otherwise(""), text))
        return poisson_quantile((hex_number(digest, 1, 13) + F.lit(0.5)) / F.lit(float(2**52)), rate / parts)

    more = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda acc, k: acc + one(k))
    return F.when(parts == 1, one(F.lit(0))).otherwise(more)


def rates(df: DataFrame, group: str, weights: dict[str, float] | None, total: float | None = None, other: float = 0.0) -> DataFrame:
    """(group, size, rate): rate = weight x total / size, weights normalised over the groups that have rows.

    total is the expected number of rows in the mix, by default that of the input. A group without a weight
    (null too) has the weight `other`. If weights is None, each group's (null is one) is its size to the power TEMPER.
    """
    if other < 0 or any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights can't be negative")
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPER))
    else:
        weight = F.coalesce(*[F.when(F.col(group) == k, F.lit(float(w))) for k, w in weights.items()], F.lit(float(other)))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("weight", weight)
    whole = sizes.agg(F.sum("size").alias("rows"), F.sum("weight").alias("weights"))
    mean = F.lit(float(total)) if total is not None else F.col("rows")
    rate = F.col("weight") / F.nullif(F.col("weights"), F.lit(0.0)) * mean / F.col("size")
    return sizes.crossJoin(F.broadcast(whole)).select(group, "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def replicate(df: DataFrame, key: str, group: str, weights: dict[str, float] | None, total: float | None = None, seed: str = SEED, other: float = 0.0) -> DataFrame:
    """df with each row repeated by its Poisson count; adds rate and replica (from 0), in place of columns of those names.

    The count depends on seed and key alone. weights and other are those of `rates`. If only listed groups can
    have rows in the mix, a row for each weight is broadcast; else the groups are counted first and joined by
    shuffle beyond BROADCAST_ROWS of them.
    """
    rows = df.select(whole_row(df, ("rate", "replica")), F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("group"))
    wanted = rates(rows.select("group"), "group", weights, total, other).where("rate > 0").select(F.col("group").alias("_group"), "rate")
    if weights is None or other > 0:
        wanted = written(wanted, "rates")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    else:
        wanted = F.broadcast(wanted.where(F.col("_group").isin(list(weights))))
    joined = rows.join(wanted, F.col("group").eqNullSafe(F.col("_group"))).withColumn("n", poisson_count(F.col("key"), F.col("rate"), seed))
    return joined.where("n > 0").select("row.*", "rate", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("replica"))


def _order_text(seed: str, *rest) -> Column:
    return F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("replica"), *rest)


def shuffled(df: DataFrame, key: str, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """df in a global random order: adds position, gapless from 0, by the MD5 of seed, key and replica, in place of a column of that name."""
    rows = df.select(whole_row(df, ("position",)), F.col(f"`{key}`").alias("key"), F.col("replica"))
    ordered = rows.withColumn("order", F.md5(_order_text(seed))).withColumn("bucket", hex_number(F.col("order"), 1, 8) % buckets)
    return gapless(ordered, [], "bucket", [F.col("order")], "position").select("row.*", "position")


def laid_out(df: DataFrame, key: str, seed: str = SEED) -> DataFrame:
    """df's rows in a random order within and across partitions, without a column of it: for writing a mix.

    The order is by the MD5 of seed, key, replica and a hash of the row, so rows of one key are spread too.
    """
    rows = df.select(whole_row(df), F.col(f"`{key}`").alias("key"), F.col("replica")).withColumn("order", F.md5(_order_text(seed, F.xxhash64("row"))))
    return rows.repartition("order").sortWithinPartitions("order").select("row.*")


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to LANGUAGE_WEIGHTS, as many rows as documents are expected, in a global random order.

    Null and empty texts are mixed like any other; documents of null or unlisted language have weight 0. Rows
    that repeat a doc_id share its count; those of one replica tie and have neighbouring positions in any order. An
    empty table gives no rows. Further columns are kept whatever their names; only rate, replica and position are replaced.
    """
    docs = table(spark, sf_dir, "documents")
    return shuffled(replicate(docs, "doc_id", "lang", LANGUAGE_WEIGHTS), "doc_id")


OP1_SQL = f"""
WITH sizes AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang),
w AS (SELECT lang, size, CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in LANGUAGE_WEIGHTS.items())} ELSE 0.0 END::DOUBLE AS weight FROM sizes),
r AS (SELECT lang, weight / (SELECT sum(weight) FROM w) * (SELECT sum(size) FROM w) / size AS rate FROM w WHERE weight > 0),
u AS (SELECT d.*, rate, (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM documents d JOIN r USING (lang)),
terms AS (SELECT lang, rate, k, exp(-rate) * list_product([rate / x FOR x IN range(1, k + 1)]) AS p FROM r, range(0, 84) t(k)),
cdf AS (SELECT lang, k, sum(coalesce(p, exp(-rate))) OVER (PARTITION BY lang ORDER BY k) AS c FROM terms),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.rate, count(*) FILTER (u.u >= cdf.c) AS n
      FROM u JOIN cdf USING (lang) GROUP BY ALL),
rep AS (SELECT *, unnest(range(0, n))::INT AS replica FROM n WHERE n > 0),
k AS (SELECT *, md5('{SEED}-order:' || doc_id || ':' || replica) AS o FROM rep)
SELECT doc_id, text, lang, source, n_chars, rate, replica,
       row_number() OVER (ORDER BY ('0x' || substr(o, 1, 8))::BIGINT % {BUCKETS}, o) - 1 AS position FROM k
"""
