"""Importance resampling towards a target: hashed n-gram features with a head vocabulary, bucket gains, Gumbel top-k draw."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import crc32_sql, fields, hex_number, small_batches, table, written

BUCKETS = 10_000
MAX_WORDS = 1
MIN_WORDS = 20
DRAW_PERCENT = 10
SEED = "2024"
#: Frequent words and pairs whose CRCs are sent to all tasks; longer ones than HEAD_BYTES never are.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 30_000, 60_000, 64
#: Levels of counts in a doubling.
LEVELS = 8
#: Distinct words or pairs that a task counts before it passes its counts on.
COUNTED = 200_000

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if c in _SEPARATORS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased runs of ASCII letters and digits and of all characters beyond ASCII, as UTF-8."""
    return text.translate(_TABLE).split() if text else []


class _States(dict):
    """CRC-32 of frequent words; any other word's is computed when asked for."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Head:
    """Buckets of a text's features: runs of 1 to n words joined by a space.

    Frequent words have their CRC states at hand, which longer features go on from; frequent pairs have their
    buckets. A feature outside the head takes its CRC directly, so buckets don't depend on what the head holds.
    """

    def __init__(self, words: list[bytes], pairs: list[bytes], n: int = MAX_WORDS, buckets: int = BUCKETS):
        self.n, self.buckets = n, buckets
        self.states = _States((w, zlib.crc32(w)) for w in words)
        self.pairs = {tuple(p.split(b" ")): zlib.crc32(p) % buckets for p in pairs}

    def of(self, words: list[bytes]) -> np.ndarray:
        states = np.fromiter(map(self.states.__getitem__, words), np.int64, len(words))
        out = [states % self.buckets]
        if self.n >= 2:
            last = states.tolist()
            known = self.pairs.get
            for k in range(2, self.n + 1):
                ends = words[k - 1 :]
                if k == 2 == self.n:
                    own = [b if (b := known(p)) is not None else zlib.crc32(b" " + p[1], s) % self.buckets for p, s in zip(zip(words, ends), last)]
                else:
                    last = [zlib.crc32(b" " + w, s) for w, s in zip(ends, last)]
                    own = [s % self.buckets for s in last]
                out.append(np.array(own, np.int64))
        return np.concatenate(out)


def _texts(rows: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    for batch in rows:
        yield from batch.column("text").cast(pa.binary()).to_pylist()


def frequent(docs: DataFrame, pairs: bool, most: int) -> list[bytes]:
    """The most frequent words (or pairs of neighbours) of all texts: all of the highest levels of counts that hold `most` or fewer.

    Counts are exact and cover all texts; `most` bounds what comes to the driver.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

        for text in _texts(rows):
            own = words_of(text)
            counts.update(map(b" ".join, zip(own, own[1:])) if pairs else own)
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        yield out()

    counted = docs.select("text").mapInArrow(count, fields("feature binary, n long")).where(F.length("feature") <= HEAD_BYTES)
    counted = counted.groupBy("feature").agg(F.sum("n").alias("n")).where("n > 1")
    counted = written(counted.select("feature", F.floor(LEVELS * F.log2("n")).alias("level")), "features")
    left, least = most, None
    for r in sorted(counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # 64 x LEVELS at most
        left -= r.n
        if left < 0:
            break
        least = r.level
    return sorted(bytes(r.feature) for r in counted.where(F.col("level") >= least).collect()) if least is not None else []


def bucket_totals(docs: DataFrame, head: Head) -> np.ndarray:
    """The exact number of features in each bucket over all texts; each task sends its own sums."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(head.buckets, np.int64)
        for text in _texts(rows):
            if own := words_of(text):
                total += np.bincount(head.of(own), minlength=head.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(count, fields("bucket long, n long")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(head.buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln) of its share in the target over that in the source, both with one feature more in each bucket."""
    m, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + m) / ((s + 1) * (all_t + m)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, head: Head, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight) of each row; a text without words has zeros."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [(len(own), *_sum(own)) if (own := words_of(t)) else (0, 0, 0) for t in _texts([batch])]
            values = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(values[:, i]) for i in range(3))], names=["key", "n_words", "n_features", "weight"])

    def _sum(own: list[bytes]) -> tuple[int, int]:
        buckets = head.of(own)
        return len(buckets), int(gain[buckets].sum())

    schema = fields("key long, n_words long, n_features long, weight long")
    schema["key"].dataType = docs.schema[key].dataType
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(run, schema).withColumnRenamed("key", key)


def gumbel(key: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u a uniform of the first 32 bits of the SHA-256 of seed:key; a null key counts as an empty one."""
    h = hex_number(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, key: str, percent: int) -> DataFrame:
    """Adds rank to the floor(percent x rows / 100) highest scores, ties to the smaller key (null last), null for others.

    Rows are dealt out by ranges of (score, key, own number), so neither ties nor repeated rows fill one task; a
    row's rank is the rows of the ranges before plus its place in its own.
    """
    order = [F.desc("score"), F.asc_nulls_last(key)]
    dealt = scored.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row")
    dealt = written(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("_at", 33)
    counts = dict(dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before, total = [], 0
    for k, n in sorted(counts.items()):
        before.append((k, total))
        total += n
    drawn = percent * total // 100
    offsets = scored.sparkSession.createDataFrame(before or [(0, 0)], fields("_part long, _before long"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.select(*scored.columns, F.when(place <= drawn, place).cast("bigint").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", n: int = MAX_WORDS, buckets: int = BUCKETS, least: int = MIN_WORDS, percent: int = DRAW_PERCENT, seed: str = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of each row of docs (key, text), drawn towards the texts of target.

    Without target texts all buckets are weighed against a flat target. Null and wordless texts weigh 0 and aren't
    drawn; repeated rows are drawn each. Texts of any length are read whole, a text at a time.
    """
    if n < 1 or not 0 <= percent <= 100:
        raise ValueError("n is 1 or more and percent 0 to 100")
    small_batches(docs.sparkSession)
    head = Head(frequent(docs, False, HEAD_WORDS), frequent(docs, True, HEAD_PAIRS) if n >= 2 else [], n, buckets)
    gain = gains(bucket_totals(docs, head), bucket_totals(target, head))
    scored = written(weighed(docs, head, gain, key).withColumn("score", (F.col("weight") + gumbel(F.col(key), seed)).cast("bigint")), "weighed")
    enough = F.col("n_words") >= least
    return ranked(scored.where(enough), key, percent).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint")))


def op13_head_tail_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight and score towards `benchmark`, and the rank of those that are drawn.

    Null, empty and wordless texts have no features, weight 0 and no rank; rows that repeat a doc_id share its
    noise and are ranked each, in any order if they tie; a null doc_id counts as an empty one and comes last among
    ties. Other columns of the tables aren't read. An empty table of documents gives no rows, an empty benchmark
    a flat target.
    """
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _op13_sql() -> str:
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    words = lambda t: f"SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {t}"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, ws FROM ({words('documents')})), b AS MATERIALIZED (SELECT ws FROM ({words('benchmark')})),
x AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w FROM d), y AS MATERIALIZED (SELECT unnest(ws) AS w FROM b),
v AS MATERIALIZED (SELECT w, {crc32_sql('hex(encode(w))')} % {BUCKETS} AS bucket FROM (SELECT w FROM x UNION SELECT w FROM y)),
s AS (SELECT bucket, count(*) AS s FROM x JOIN v USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM y JOIN v USING (w) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM x) + {BUCKETS} AS s_all, (SELECT count(*) FROM y) + {BUCKETS} AS t_all),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * s_all)::DOUBLE / ((s + 1) * t_all)::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
p AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM x JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
z AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN p USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, {DRAW_PERCENT} * count(*) OVER () // 100 AS drawn FROM z WHERE n_features >= {MIN_WORDS})
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)
"""


OP13_SQL = _op13_sql()
