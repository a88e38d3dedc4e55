"""Media columns as content-defined chunks: every distinct chunk is stored once, an ordered list rebuilds a payload."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import BROADCAST_ROWS, fields, scratch, table

#: A payload is padded with zeros to a multiple of this.
UNIT = 64
#: Bytes of a chunk: least, most; a cut is where the hash's upper bits are zero, once in 2**CUT_BITS bytes.
LEAST, MOST, CUT_BITS = 512, 8192, 11
#: Bytes that are hashed at once.
BATCH = 4_000_000

_GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash after each byte: the sum of the last 32 bytes' values, each shifted by its distance.

    Doubling the window five times gives the sum; bytes before the first count as nothing.
    """
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def cuts(payloads: list[bytes]) -> list[list[int]]:
    """Each payload's chunk ends. They depend on nearby bytes, so an insertion moves few of them."""
    out: list[list[int]] = []
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    marks = np.flatnonzero(gear(joined) >> np.uint32(32 - CUT_BITS) == 0) + 1
    begin = 0
    for p in payloads:
        end, at, own = begin + len(p), begin, []
        k = int(np.searchsorted(marks, begin + LEAST))
        while at < end:
            while k < len(marks) and marks[k] < at + LEAST:
                k += 1
            to = min(end, at + MOST, int(marks[k]) if k < len(marks) else end)
            own.append(to - begin)
            at = to
        out.append(own)
        begin = end
    return out


def payload(text: str | None) -> tuple[bytes, int]:
    """A text's bytes with zeros up to a positive multiple of UNIT, and their number without."""
    data = (text or "").encode()
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def _chunked(texts: list) -> Iterator[tuple[int, int, list[tuple[bytes, bytes]]]]:
    """(index, bytes without padding, chunks with their SHA-256) of each text."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at + len(group) < len(texts) and size < BATCH:
            group.append(payload(texts[at + len(group)]))
            size += len(group[-1][0])
        for i, ((data, n), ends) in enumerate(zip(group, cuts([p for p, _ in group]))):
            chunks = [data[a:b] for a, b in zip([0, *ends], ends)]
            yield at + i, n, [(hashlib.sha256(c).digest(), c) for c in chunks]
        at += len(group)


def manifest(digests: list[bytes], sizes: list[int]) -> bytes:
    """The ordered chunk list: each chunk's SHA-256 and length in 32 bits."""
    return b"".join(d + n.to_bytes(4, "little") for d, n in zip(digests, sizes))


def repeated_digests(docs: DataFrame) -> DataFrame:
    """Digests of the chunks that occur more than once in all payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [d for _, _, chunks in _chunked(batch.column("text").to_pylist()) for d, _ in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["digest"])

    return docs.select("text").mapInArrow(run, fields("digest binary")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")


#: A row of the table of packs. `shared` says which chunks of the list are in the table of shared chunks; the others'
#: bytes, which no other place holds, are the body.
PACKS = fields("doc_id long, n_bytes long, recipe binary, digests array<binary>, sizes array<int>, shared array<boolean>, body binary")
SHARED = fields("digest binary, bytes binary")


def _heads(digests: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64)


def _packed(docs: DataFrame, heads) -> DataFrame:
    """Rows of packs; heads: the sorted first eight bytes of shared digests, or None to take the column `repeated`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if heads is None else heads.value
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            flags = batch.column("repeated").to_pylist() if known is None else None
            rows = []
            for i, n, chunks in _chunked(texts):
                digests, sizes = [d for d, _ in chunks], [len(c) for _, c in chunks]
                if known is None:
                    own = set(flags[i] or ())
                    shared = [k in own for k in range(len(chunks))]
                else:
                    place = np.searchsorted(known, h := _heads(digests))
                    shared = (known[np.minimum(place, len(known) - 1)] == h).tolist() if len(known) else [False] * len(chunks)
                recipe = hashlib.sha256(manifest(digests, sizes)).digest()
                rows.append((doc_ids[i], n, recipe, digests, sizes, shared, b"".join(c for (_, c), s in zip(chunks, shared) if not s)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=PACKS.names)

    return docs.mapInArrow(run, PACKS)


def _located(docs: DataFrame) -> DataFrame:
    """(recipe, n, digest) of each chunk of each payload, without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes, numbers, digests = [], [], []
            for _, _, chunks in _chunked(batch.column("text").to_pylist()):
                own = [d for d, _ in chunks]
                recipe = hashlib.sha256(manifest(own, [len(c) for _, c in chunks])).digest()
                recipes += [recipe] * len(own)
                numbers += range(len(own))
                digests += own
            yield pa.RecordBatch.from_arrays([pa.array(recipes, pa.binary()), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary())], names=["recipe", "n", "digest"])

    return docs.select("text").mapInArrow(run, fields("recipe binary, n int, digest binary"))


def _shared_chunks(docs: DataFrame, heads, wanted: DataFrame) -> DataFrame:
    """The shared chunks, each once: tasks give a chunk's bytes once, then a join keeps the wanted and an aggregate one of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = None if heads is None else heads.value, set()
        for batch in batches:
            out = []
            for _, _, chunks in _chunked(batch.column("text").to_pylist()):
                if known is not None and len(known):
                    place = np.searchsorted(known, h := _heads([d for d, _ in chunks]))
                    chunks = [c for c, s in zip(chunks, (known[np.minimum(place, len(known) - 1)] == h).tolist()) if s]
                for d, c in chunks:
                    if d not in seen:
                        seen.add(d)
                        out.append((d, c))
                if len(seen) > 500_000:
                    seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], names=SHARED.names)

    found = docs.select("text").mapInArrow(run, SHARED)
    return found.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("bytes").alias("bytes"))


def store(docs: DataFrame, path: str, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Stores the payloads of docs (doc_id, text) below path: `packs`, a row for each document, and `shared`.

    Which chunks occur more than once is counted over all payloads. Their digests' first bytes go to all tasks if
    there are at most broadcast_rows of them; no payload is moved then. Else payloads meet the numbers of their
    repeated chunks in a join, which shuffles each payload once.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    repeated_digests(docs).write.parquet(f"{path}/repeated")
    wanted = spark.read.schema("digest binary").parquet(f"{path}/repeated")
    heads = None
    if wanted.count() <= broadcast_rows:
        first = wanted.select(F.substring("digest", 1, 8).alias("d")).collect()
        heads = spark.sparkContext.broadcast(np.unique(_heads([bytes(r.d) for r in first])) if first else np.zeros(0, np.uint64))
        packs = _packed(docs, heads)
    else:
        numbers = _located(docs).distinct().join(wanted, "digest").groupBy("recipe").agg(F.collect_set("n").alias("repeated"))
        named = docs.mapInArrow(_with_recipe, fields("doc_id long, text string, recipe binary"))
        packs = _packed(named.join(numbers, "recipe", "left").select("doc_id", "text", "repeated"), None)
    packs.write.option("compression", "zstd").parquet(f"{path}/packs")
    _shared_chunks(docs, heads, wanted).write.option("compression", "zstd").parquet(f"{path}/shared")


def _with_recipe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        recipes = [hashlib.sha256(manifest([d for d, _ in chunks], [len(c) for _, c in chunks])).digest() for _, _, chunks in _chunked(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").cast(pa.string()), pa.array(recipes, pa.binary())], names=["doc_id", "text", "recipe"])


def feature(data: bytes, sizes: list[int]) -> str:
    """Of a payload as it was read: chunks, the samples' sum, how often they cross 128, and a histogram in 16 bins."""
    x = np.frombuffer(data, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"chunks={len(sizes)};sum={int(x.sum(dtype=np.int64))};crossings={crossings};bins={'/'.join(map(str, bins.tolist()))}"


REBUILT = fields("recipe binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts payloads together, checks every chunk against its digest, and describes what was read."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            fetched = {x["n"]: x["bytes"] for x in row.get("fetched") or ()}
            at, parts = 0, []
            for k, (digest, size, shared) in enumerate(zip(row["digests"], row["sizes"], row["shared"])):
                own = fetched[k] if shared else row["body"][at : at + size]
                at += 0 if shared else size
                if hashlib.sha256(own).digest() != digest:
                    raise ValueError("a chunk differs from its digest")
                parts.append(own)
            data = b"".join(parts)
            media = manifest(row["digests"], row["sizes"]) + data
            rows.append((row["recipe"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(data, row["sizes"])))
        if rows:
            types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=REBUILT.names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_bytes, and what REBUILT has) of each stored document.

    Payloads without shared chunks are read where they are. The others are put together once for each chunk list:
    only shared chunks, and the bodies beside them, are shuffled.
    """
    packs = spark.read.schema(PACKS).parquet(f"{path}/packs")
    shared = spark.read.schema(SHARED).parquet(f"{path}/shared")
    has = F.exists("shared", lambda x: x)
    whole = packs.where(~has).select("recipe", "digests", "sizes", "shared", "body").mapInArrow(_rebuild, REBUILT)
    needs = packs.where(has).select("recipe", "digests", "shared").dropDuplicates(["recipe"])
    needs = needs.select("recipe", F.posexplode(F.arrays_zip("digests", "shared")).alias("n", "x")).where("x.shared").select("recipe", "n", F.col("x.digests").alias("digest"))
    fetched = needs.join(shared, "digest").groupBy("recipe").agg(F.collect_list(F.struct("n", "bytes")).alias("fetched"))
    split = packs.where(has).select("recipe", "digests", "sizes", "shared", "body").dropDuplicates(["recipe"]).join(fetched, "recipe").mapInArrow(_rebuild, REBUILT)
    return packs.select("doc_id", "n_bytes", "recipe").join(whole.union(split), "recipe").drop("recipe")


def op5_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload, stored in chunks and read back.

    The stored form is the chunk list followed by the chunks' bytes as read. Null and empty texts are 64 zeros;
    rows that repeat a doc_id have a row each; an empty table gives no rows.
    """
    path = scratch(spark, "media")
    store(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
