"""Token ids in files of a static range asymmetric numeral system with shared frequencies and independent blocks."""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import fields, scratch, small_batches, table
from freshet.llm.tokens import END_ID, batches, crc32, crc32_shifted, encoded

TOKENIZER = "byte_bpe_50k.json"
#: Ids are below this (both public byte-level vocabularies fit); it bounds the frequency table.
VOCABULARY = 1 << 16
SCALE_BITS = 18
BLOCK_TOKENS = 1 << 18
LANES = 1024
#: Steps of all lanes between two places in a block from which decoding can begin.
CHECKPOINT_STEPS = 128
#: Documents of a part, the unit of ordering; a part is sorted by one task.
PART_DOCUMENTS = 5000
MAX_PARTS = 4096

#: Characters of texts that are encoded together, so that a word they share is looked up once.
TOGETHER_CHARS = 16_000_000

#: States lie between _LOW and _LOW << 32, below 2**53: as doubles they are exact, and so are their quotients rounded down.
_LOW = 1 << 20
_HEADER = struct.Struct("<4s6I")
_MAGIC = b"rAN2"


def normalised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each id that occurs, as near the counts as that allows."""
    counts = np.asarray(counts, np.float64)
    present = counts > 0
    if not present.any():
        return np.zeros(len(counts), np.int64)
    spare = (1 << bits) - int(present.sum())
    if spare < 0:
        raise ValueError("more ids than the scale has slots")
    exact = counts / counts.sum() * spare
    freq = np.floor(exact).astype(np.int64)
    rest = spare - int(freq.sum())
    order = np.argsort(-(exact - freq), kind="stable")[:rest]
    freq[order] += 1
    return freq + present


class Coder:
    """Encodes and decodes blocks of ids under one table of frequencies."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = bits
        self.freq = freq.astype(np.int64)
        self.first = np.zeros(len(freq), np.int64)
        self.first[1:] = np.cumsum(self.freq)[:-1]
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        """A block: header, lane states, checkpoints (step, word, states), then 32-bit words.

        Id i goes to lane i % lanes. The lanes take their steps from the last to the first, so that a reader takes
        them, and the words, from first to last.
        """
        n = len(ids)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        freq, first = self.freq.take(ids).astype(np.float64), self.first.take(ids).astype(np.float64)
        most, rest = freq * float(_LOW << 32 >> self.bits), float(1 << self.bits) - freq
        state = np.full(lanes, float(_LOW))
        left: list[np.ndarray] = []  # states whose low 32 bits become words
        n_words, marks = 0, []
        for s in range(steps - 1, -1, -1):
            own = slice(s * lanes, min(n, (s + 1) * lanes))
            x, f = state[: own.stop - own.start], freq[own]
            full = (x >= most[own]).nonzero()[0]
            if len(full):
                wide = x[full]
                left.append(wide)
                n_words += len(full)
                x[full] = np.floor(wide * 2.0**-32)
            q = x / f
            np.floor(q, out=q)
            q *= rest[own]  # x becomes q << bits, the remainder and the first slot in one
            q += first[own]
            x += q
            if s % CHECKPOINT_STEPS == 0 and s:
                marks.append((s, n_words, state.astype(np.uint64)))
        body = np.concatenate([*reversed(left), np.zeros(0)]).astype(np.uint64).astype(np.uint32).tobytes()
        table = b"".join(struct.pack("<2I", s, n_words - w) + x.tobytes() for s, w, x in reversed(marks))
        inner = state.astype(np.uint64).tobytes() + table + body
        return _HEADER.pack(_MAGIC, n, lanes, n_words, len(marks), crc32(ids.astype("<u2").tobytes()), crc32(inner)) + inner

    def decode(self, block: bytes, part: int | None = None) -> np.ndarray:
        """All ids of a block, checked, or those from its checkpoint number `part` (0 is the start) to the next."""
        magic, n, lanes, n_words, marks, ids_crc, inner_crc = _HEADER.unpack_from(block)
        if magic != _MAGIC or crc32(memoryview(block)[_HEADER.size :]) != inner_crc:
            raise ValueError("a damaged block")
        at = _HEADER.size
        points = [(0, 0, np.frombuffer(block, np.int64, lanes, at))]
        at += 8 * lanes
        for _ in range(marks):
            s, w = struct.unpack_from("<2I", block, at)
            points.append((s, w, np.frombuffer(block, np.int64, lanes, at + 8)))
            at += 8 + 8 * lanes
        words = np.frombuffer(block, np.uint32, n_words, at).astype(np.int64)
        steps = -(-n // lanes)
        begin, w, state = points[part or 0]
        if part is not None:
            steps = points[part + 1][0] if part < marks else steps
        state = state.copy()
        out = np.empty(n, np.uint16)
        mask = (1 << self.bits) - 1
        for s in range(begin, steps):
            own = out[s * lanes : (s + 1) * lanes]
            x = state[: len(own)]
            slot = x & mask
            own[:] = ids = self.symbol.take(slot)
            x >>= self.bits
            x *= self.freq.take(ids)
            slot -= self.first.take(ids)
            x += slot
            low = (x < _LOW).nonzero()[0]
            if len(low):
                x[low] = (x[low] << 32) | words[w : w + len(low)]
                w += len(low)
        if part is not None:
            return out[begin * lanes : min(n, steps * lanes)]
        if crc32(out.astype("<u2", copy=False).tobytes()) != ids_crc:
            raise ValueError("a block's ids differ from its checksum")
        return out


BLOCKS = fields("part int, first long, n_tokens long, doc_no array<long>, doc_id array<long>, doc_from array<long>, doc_tokens array<long>, length array<long>, payload binary")
#: Blocks whose payload is the ids as they are (16 bits each); a task's last row holds how often it has met each id, and no block.
ORDERED = T.StructType([*BLOCKS, *fields("seen array<int>, times array<long>")])
_ARROW = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5, pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
DECODED = fields("part int, doc_no long, doc_id long, start long, length long, crc long")


def _short(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones; an error if one is too large."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >= VOCABULARY:
        raise ValueError(f"the tokenizer has ids of {VOCABULARY} or more")
    return wide.astype("<u2").tobytes()


def _together(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """doc_id and text of about TOGETHER_CHARS characters at a time."""
    doc_ids, texts, size = [], [], 0
    for batch in rows:
        own_ids, own = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in batches(own, TOGETHER_CHARS):
            chars = sum(len(x or "") for x in own[a:b])
            if texts and size + chars > TOGETHER_CHARS:
                yield doc_ids, texts
                doc_ids, texts, size = [], [], 0
            doc_ids += own_ids[a:b]
            texts += own[a:b]
            size += chars
    if texts:
        yield doc_ids, texts


def _row(values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _ARROW)], names=ORDERED.names[: len(values)])


def ordered_ids(docs: DataFrame, path: str) -> DataFrame:
    """All ids in ascending doc_id order, cut into blocks: parts by ranges of doc_id, numbered rows inside.

    The ranges come from approximate quantiles of doc_id alone. Null ids come first; rows with equal ids stay
    apart as rows, in the order of their token ids. A part holds about PART_DOCUMENTS rows, more only beyond MAX_PARTS parts.
    A block holds consecutive rows of a part; long documents continue in the next block.
    """
    n = docs.count()
    parts = max(1, min(MAX_PARTS, -(-n // PART_DOCUMENTS)))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []

    def tokenise(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in _together(rows):
            ids = [_short(x) + END_ID.to_bytes(2, "little") for x in encoded(path, texts)]
            part = [0 if d is None else bisect.bisect_right(bounds, d) for d in doc_ids]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        pieces, data = [], []
        part, doc_no, start, size = -1, 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload = b"".join(data)
            total[:] += np.bincount(np.frombuffer(payload, "<u2"), minlength=VOCABULARY)
            row = [part, start - size, size, *map(list, zip(*pieces)), payload, None, None]
            pieces.clear()
            data.clear()
            return _row(row)

        for batch in rows:
            for p, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if p != part:
                    if pieces:
                        yield flush()
                    part, doc_no, start, size = p, 0, 0, 0
                n, a = len(ids) // 2, 0
                while a < n:
                    length = min(n - a, BLOCK_TOKENS - size)
                    pieces.append((doc_no, doc_id, a, n, length))
                    data.append(ids[2 * a : 2 * (a + length)])
                    a += length
                    size += length
                    start += length
                    if size == BLOCK_TOKENS:
                        yield flush()
                        size = 0
                doc_no += 1
        if pieces:
            yield flush()
        if total.any():
            own = np.flatnonzero(total)
            yield _row([part, start, 0, *[None] * 6, own, total[own]])

    ids = docs.select("doc_id", "text").mapInArrow(tokenise, fields("part int, doc_id long, ids binary"))
    return ids.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(cut, ORDERED)


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows of ordered_ids, from the tasks' counts: at most VOCABULARY sums come to the driver."""
    each = ids.where("seen IS NOT NULL").select(F.explode(F.arrays_zip("seen", "times")).alias("x"))
    counts = np.zeros(VOCABULARY, np.int64)
    for id_, n in each.groupBy("x.seen").agg(F.sum("x.times")).collect():
        counts[id_] = n
    return counts


def blocks(ids: DataFrame, freq: np.ndarray) -> DataFrame:
    """The blocks of ordered_ids with encoded payloads."""

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in rows:
            payloads = [coder.encode(np.frombuffer(x.as_buffer(), "<u2")) for x in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(payloads, pa.binary())], names=BLOCKS.names)

    return ids.where("n_tokens > 0").select(BLOCKS.names).mapInArrow(encode, BLOCKS)


def write_ids(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes docs' ids below path: `blocks` (the encoded ids), `frequencies` and `parts` (tokens of each part)."""
    spark = docs.sparkSession
    small_batches(spark)
    staged = scratch(spark, "ordered-ids")
    ordered_ids(docs, tokenizer).write.option("compression", "zstd").parquet(staged)
    ids = spark.read.schema(ORDERED).parquet(staged)
    freq = normalised(id_counts(ids))
    blocks(ids, freq).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    used = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(used, "id int, frequency int").coalesce(1).write.parquet(f"{path}/frequencies")
    ids.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).coalesce(1).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the blocks: (part, doc_no, doc_id, start in the part, length, crc), a row for each document and block.

    crc is the piece's share of the CRC-32 of the document's ids; the XOR of a document's shares is the CRC.
    """
    freq = np.zeros(VOCABULARY, np.int64)
    for id_, n in spark.read.schema("id int, frequency int").parquet(f"{path}/frequencies").collect():  # at most VOCABULARY
        freq[id_] = n

    def decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in rows:
            for row in batch.to_pylist():
                data = coder.decode(row["payload"]).astype("<u4").tobytes()
                out, at = [], 0
                for doc_no, doc_id, a, n, length in zip(row["doc_no"], row["doc_id"], row["doc_from"], row["doc_tokens"], row["length"]):
                    crc = crc32_shifted(crc32(data[4 * at : 4 * (at + length)]), 4 * (n - a - length))
                    out.append((row["part"], doc_no, doc_id, row["first"] + at, length, crc))
                    at += length
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int32(), *[pa.int64()] * 5])], names=DECODED.names)

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, DECODED)


def documents_read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in files that write_ids wrote."""
    parts = spark.read.schema("part int, tokens long").parquet(f"{path}/parts")  # at most MAX_PARTS rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("_before"))
    docs = read_ids(spark, path).groupBy("part", "doc_no", "doc_id").agg(
        F.min("start").alias("start"), F.sum("length").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")
    )
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def op4_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written in ascending doc_id order and read back.

    Null and empty texts are the end id alone; rows that repeat a doc_id follow each other; an empty table
    gives no rows.
    """
    path = scratch(spark, "rans")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return documents_read(spark, path)
