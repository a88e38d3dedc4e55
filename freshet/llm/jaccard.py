"""Exact Jaccard self-join of documents' word shingles with PartEnum signatures, and the classes of linked documents."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.common import BROADCAST_ROWS, fields, from_planes, planes, small_batches, table, written
from freshet.llm.tokens import batches

#: Elements of a range that one task compares, and those that a task sends at once.
GROUP_ELEMENTS, SENT_ELEMENTS = 3_000_000, 1_500_000
#: Words whose hashes a worker remembers.
REMEMBERED = 250_000
#: Sets of a block; all pairs of two blocks are compared by one task.
BLOCK = 96
#: A hub's nodes are dealt out in parts of about so many where it is joined.
PART = 256
#: Steps, in percent, of the sizes and of the shares of unique elements by which a large hub's nodes are binned.
BIN_PERCENT = 2
#: Least and most cells of the histograms whose distance bounds that of two sets from below.
CELLS = 128, 8192

_words: dict[bytes, int] = {}


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Each text's sorted 64-bit hashes of its distinct n-word shingles, A-Z lower-cased.

    Fewer than n words are one shingle; no words or None give an empty set.
    """
    words = [t.encode().lower().split() if t else [] for t in texts]
    fresh = {w for own in words for w in own if w not in _words}
    if len(_words) + len(fresh) > REMEMBERED:
        _words.clear()
        fresh = {w for own in words for w in own}
    _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
    counts = np.array([len(own) for own in words], np.int64)
    hashes = np.fromiter((_words[w] for own in words for w in own), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    rolled = np.zeros(0, np.uint64)
    if len(hashes) >= n:
        rolled = hashes[: len(hashes) - n + 1].copy()
        for j in range(1, n):
            rolled = _mix(rolled, j) + hashes[j : len(hashes) - n + 1 + j]
        rolled = _mix(rolled, n)
    out = []
    for own, end in zip(words, ends.tolist()):
        if len(own) >= n:
            out.append(np.unique(rolled[end - len(own) : end - n + 1]))
        elif own:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(own), n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=8)
def bands(percent: int, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """The first and last size of each band. Similar sets are in one band or in neighbouring ones."""
    first, last = [1], []
    while first[-1] <= largest:
        last.append(max(first[-1] * 100 // percent, first[-1] * WIDTH_PERCENT // 100))
        first.append(last[-1] + 1)
    return np.array(first[:-1], np.int64), np.array(last, np.int64)


#: A band's last size as a percentage of its first, where similarity alone would allow less.
WIDTH_PERCENT = 125
#: Partitions of the domain for each that must be equal, where one partition makes a signature.
SLACK_PERCENT = 115
#: Bands whose sets may differ in at most so many elements enumerate subsets of several partitions.
MOST_ENUMERATED = 8
#: Partitions of those bands beyond the ones that may differ: the size of the enumerated subsets.
SUBSET = 2


def least_elements(percent: int) -> int:
    return 3 if percent >= 88 else 1


@lru_cache(maxsize=16)
def subsets(differ: int) -> np.ndarray:
    """All subsets of SUBSET of the partitions that a band of so many differences has."""
    return np.array(list(combinations(range(differ + SUBSET), SUBSET)), np.int64)


def signatures(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Each set's PartEnum signatures: two sets of Jaccard similarity >= percent that differ share one at least.

    Two such sets of at most b elements differ in at most k = 2b(100 - percent) / (100 + percent) elements, b the
    last size of the larger one's band; a set also signs for the next band if it could be similar to a set there.
    The domain is hashed into partitions, of which all but k hold the same elements of both sets. With k up to
    MOST_ENUMERATED there are k + SUBSET of them, and a signature is the content of one of all the subsets of
    SUBSET partitions. Beyond, such subsets would be too many: there are SLACK_PERCENT of k + 1 partitions, and the
    enumerated subsets are single ones (the first level with a second level of two, any one of which may differ).
    Subsets with few elements say little: a set with more than k well-filled partitions signs only with subsets
    that hold enough, as one of them is equal in both sets; one with fewer signs with all.
    """
    first, last = bands(percent)
    size = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(last, size)
    upper = band + 1
    jobs = [(np.flatnonzero(size > 0), band)]
    jobs.append((np.flatnonzero((size > 0) & (size * 100 >= percent * first[upper])), upper))
    found: list[list[np.ndarray]] = [[] for _ in sets]
    for own, tag in jobs:
        differ = 2 * last[tag[own]] * (100 - percent) // (100 + percent)
        own, differ = own[differ > 0], differ[differ > 0]
        if not len(own):
            continue
        few = differ <= MOST_ENUMERATED
        parts = np.where(few, differ + SUBSET, np.maximum((differ + 1) * SLACK_PERCENT // 100, differ + 1))
        least = np.where(few, 1, least_elements(percent))
        base = np.cumsum(parts) - parts
        mixed = _mix(np.concatenate([sets[i] for i in own.tolist()]), 0x51ED)
        counts = size[own]
        place = ((mixed >> np.uint64(32)) * np.repeat(parts, counts).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        place += np.repeat(base, counts)
        total = int(parts.sum())
        value = _mix(mixed, 0xA5A5)
        low = np.bincount(place, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(place, (value >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        filled = np.bincount(place, minlength=total)
        number = np.arange(total) - np.repeat(base, parts)
        tags = tag[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        content = _mix(low + (high << np.uint64(32)), 0x77) + number.astype(np.uint64)
        signs = _mix(content + np.repeat(tags, parts), 0x1234)
        good = filled >= np.repeat(least, parts)
        enough = np.add.reduceat(good, base) > differ
        chosen = good | np.repeat(~enough, parts)
        for i, k, a, b, t, full, enumerated in zip(own.tolist(), differ.tolist(), base.tolist(), (base + parts).tolist(), tags.tolist(), enough.tolist(), few.tolist()):
            if not enumerated:
                found[i].append(signs[a:b][chosen[a:b]])
                continue
            each = subsets(k)
            if full:
                each = each[good[a:b][each].any(axis=1)]
            named = _mix(content[a:b], 0x2F)[each]
            found[i].append(_mix(named[:, 0] + np.uint64(3) * named[:, 1] + np.uint64(t), 0x4321))
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]


def _key(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def text_digest() -> Column:
    """A 64-bit hash of `text`, by which rows that share a doc_id are told apart."""
    return F.xxhash64("text")


def _sets(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in rows:
        texts = batch.column("text").to_pylist()
        for a, b in batches(texts, 1_500_000):
            yield batch.slice(a, b - a), shingle_sets(texts[a:b], n)
    _words.clear()  # the worker lives on
    pa.default_memory_pool().release_unused()


def histogram(s: np.ndarray) -> np.ndarray:
    """How many elements fall into each cell, 255 at most; two sets differ in at least as many as their histograms.

    There is a cell for each one or two elements within the limits CELLS, a power of two of them; adjacent cells
    are added to compare with a histogram of fewer.
    """
    cells = min(max(CELLS[0], 1 << (max(1, len(s) // 2) - 1).bit_length()), CELLS[1])
    place = _mix(s, 0xBEEF) >> np.uint64(65 - cells.bit_length())
    return np.minimum(np.bincount(place.astype(np.int64), minlength=cells), 255).astype(np.uint8)


def _stacked(histograms: list[bytes]) -> np.ndarray:
    """A row for each, with as many cells as the smallest."""
    least = min(map(len, histograms))
    if all(len(h) == least for h in histograms):
        return np.frombuffer(b"".join(histograms), np.uint8).reshape(-1, least).astype(np.int16)
    return np.stack([np.frombuffer(h, np.uint8).reshape(least, -1).sum(axis=1, dtype=np.int16) for h in histograms])


def keyed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, digest, n_shingles, node, cells) of each row; digest is that of the text, node is the hash of the set, null if it is empty, cells its histogram."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, sets in _sets(rows, n):
            cells = [histogram(s).tobytes() if len(s) else None for s in sets]
            nodes = [_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [own.column("doc_id"), own.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(cells, pa.binary())],
                names=["doc_id", "digest", "n_shingles", "node", "cells"],
            )

    rows = docs.select("doc_id", text_digest().alias("digest"), "text")
    return rows.mapInArrow(run, fields("doc_id long, digest long, n_shingles long, node long, cells binary"))


def signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, node): the signatures of all sets; a task gives those of a set once."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _sets(rows, n):
            fresh = {}
            for s in sets:
                if len(s) and (k := _key(s)) not in seen:
                    seen.add(k)
                    fresh[k] = s
            if len(seen) > 2_000_000:
                seen.clear()
            if fresh:
                signs = signatures(list(fresh.values()), percent)
                nodes = np.repeat(np.array(list(fresh), np.int64), [len(x) for x in signs])
                values = np.concatenate(signs).view(np.int64)
                for a in range(0, len(values), 1_000_000):
                    yield pa.RecordBatch.from_arrays([pa.array(values[a : a + 1_000_000]), pa.array(nodes[a : a + 1_000_000])], names=["sig", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, fields("sig long, node long"))


def node_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, elements), one row for each distinct set."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(rows, n):
            sets = [s for s in sets if len(s)]
            offsets = np.cumsum([0, *(len(s) for s in sets)])
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_key(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["node", "elements"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, fields("node long, elements array<long>")).dropDuplicates(["node"])


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b): nodes of a connected component share a root.

    Each round points every node to the least of itself and its neighbours in an order that is drawn anew, then
    contracts the edges; a constant share of the nodes goes in each round, whatever the shape of the graph. Every
    round's tables are written to the shared folder.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    links = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(links))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        to = both.groupBy("a").agg(F.least(F.min(order("b")), order("a"))["v"].alias("to"))
        to = written(to.withColumnRenamed("a", "node"), "hooks")
        links.append(to)
        ends = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("p")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("q")), "b")
        edges = written(ends.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
    out = None
    for to in links:
        if out is None:
            out = to.select("node", F.col("to").alias("root"))
        else:
            out = out.join(to.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return edges.sparkSession.createDataFrame([], "node long, root long") if out is None else written(out, "roots")


def _alike(size: np.ndarray, most: np.ndarray, cells: np.ndarray, percent: int, i: int, rest: np.ndarray) -> np.ndarray:
    """Those of rest whose sizes, shared elements at most and histograms let them be similar to i."""
    rest = rest[np.minimum(most[rest], most[i]) * (100 + percent) >= percent * (size[rest] + size[i])]
    return rest[np.abs(cells[rest] - cells[i]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (size[rest] + size[i]) * (100 - percent)]


def _possible(percent: int):
    """Pairs (hub, node) whose sizes and histograms let them be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x_size", "y_size"))
            p, q = (batch.column(c).to_pylist() for c in ("x_cells", "y_cells"))
            good = np.minimum(x, y) * 100 >= percent * np.maximum(x, y)
            cells = np.minimum([len(h) for h in p], [len(h) for h in q])
            for c in np.unique(cells[good]).tolist():
                own = np.flatnonzero(good & (cells == c))
                pair = _stacked([p[i] for i in own] + [q[i] for i in own])
                apart = np.abs(pair[: len(own)] - pair[len(own) :]).sum(axis=1, dtype=np.int64)
                good[own] = apart * (100 + percent) <= (x[own] + y[own]) * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("hub", "part", "node")], names=["hub", "part", "node"])

    return run


def _open_units(percent: int):
    """Of sorted rows of units, the nodes that could be similar to one of another root in the same unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            hub, a, b, node, root, size, most = (table.column(c).to_numpy() for c in ("hub", "a", "b", "node", "root", "size", "most"))
            all_cells = table.column("cells").to_pylist()
            new = np.flatnonzero(np.concatenate([[True], (hub[1:] != hub[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            keep = np.zeros(len(hub), bool)
            for first, last in zip(new.tolist(), [*new[1:].tolist(), len(hub)]):
                if (root[first:last] == root[first]).all():
                    continue
                cells, own = _stacked(all_cells[first:last]), slice(first, last)
                for i in range(last - first - 1):
                    rest = np.arange(i + 1, last - first)
                    rest = _alike(size[own], most[own], cells, percent, i, rest[root[own][rest] != root[first + i]])
                    if len(rest):
                        keep[first + i] = True
                        keep[first + rest] = True
            if keep.any():
                columns = [pa.array(x[keep]) for x in (hub, a, b, node, root)]
                yield pa.RecordBatch.from_arrays(columns, names=["hub", "a", "b", "node", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows from the last unit's first on wait for the next batch, as the unit may go on there.
            h, a, b = (batch.column(c).to_numpy() for c in ("hub", "a", "b"))
            at = int(np.flatnonzero((h != h[-1]) | (a != a[-1]) | (b != b[-1]))[-1]) + 1 if ((h != h[-1]) | (a != a[-1]) | (b != b[-1])).any() else 0
            if at:
                held.append(batch.slice(0, at))
                yield from flush(pa.Table.from_batches(held))
                held = [batch.slice(at)]
            else:
                first = held[0] if held else None
                if first is not None and (first.column("hub")[0].as_py(), first.column("a")[0].as_py(), first.column("b")[0].as_py()) != (h[0], a[0], b[0]):
                    yield from flush(pa.Table.from_batches(held))
                    held = []
                held.append(batch)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _compared(percent: int):
    """Compares all pairs of the sets of two blocks that aren't linked yet; gives edges between roots."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        root = pdf["root"].to_numpy()
        sets = [np.asarray(x).view(np.uint64) for x in pdf["elements"]]
        size = np.array([len(s) for s in sets], np.int64)
        cells = _stacked([histogram(s).tobytes() for s in sets])
        own = dict(zip(root.tolist(), root.tolist()))

        def top(x: int) -> int:
            while own[x] != x:
                own[x] = own[own[x]]
                x = own[x]
            return x

        edges = []
        for i in range(len(sets) - 1):
            rest = np.arange(i + 1, len(sets))
            for j in _alike(size, size, cells, percent, i, rest[root[rest] != root[i]]).tolist():
                p, q = top(int(root[i])), top(int(root[j]))
                if p == q:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    own[max(p, q)] = min(p, q)
                    edges.append((min(p, q), max(p, q)))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _rows_of(docs: DataFrame, known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text) of the given nodes, from a row with the least doc_id of each, or from one without doc_id."""
    chosen = written(known.join(nodes.distinct(), "node", "left_semi").select(F.col("least").alias("_id"), F.col("digest").alias("_of")).distinct(), "chosen")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    rows = docs.select("doc_id", "text").withColumn("_digest", text_digest())
    return rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), "left_semi")


def _unique_elements(docs: DataFrame, n: int, total: int) -> DataFrame:
    """(node, alone): how many elements of each set are in no other set of docs, of `total` elements about; sets that have none are left out.

    Tasks send elements by ranges of 48 bits, a range of a batch of sets as one row: names byte by byte and the sets
    that they are of. Elements that share a name by chance count as shared, which only weakens a bound.
    """
    buckets = max(1, -(-total // GROUP_ELEMENTS))

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            unit = np.repeat(np.arange(len(nodes)), [len(s) for s in held])
            name = _mix(np.concatenate(held), 0xE1E) >> np.uint64(16)
            order = np.argsort(name)
            name, unit, own = name[order], unit[order], np.array(nodes, "<i8")
            cuts = np.searchsorted((name * np.uint64(buckets)) >> np.uint64(48), np.arange(buckets + 1).astype(np.uint64))
            out = []
            for k in range(buckets):
                if cuts[k] < cuts[k + 1]:
                    used, local = np.unique(unit[cuts[k] : cuts[k + 1]], return_inverse=True)
                    out.append((k, planes(name[cuts[k] : cuts[k + 1]], 6), planes(local, 3), own[used].tobytes()))
            nodes.clear()
            held.clear()
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "names", "units", "nodes"])

        for _, sets in _sets(rows, n):
            for s in sets:
                if len(s) and (k := _key(s)) not in seen:
                    seen.add(k)
                    nodes.append(k)
                    held.append(s)
            if len(seen) > 2_000_000:
                seen.clear()
            if sum(map(len, held)) >= SENT_ELEMENTS:
                yield flush()
        if held:
            yield flush()

    def count(group: pa.Table) -> pa.Table:
        names, units, nodes = (group.column(c).to_pylist() for c in ("names", "units", "nodes"))
        name = np.concatenate([from_planes(x, 6) for x in names])
        node = np.concatenate([np.frombuffer(own, "<i8")[from_planes(x, 3).astype(np.int64)] for x, own in zip(units, nodes)])
        order = np.argsort(name)
        name, node = name[order], node[order]
        at = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        least = np.minimum.reduceat(node, at)
        alone, times = np.unique(least[least == np.maximum.reduceat(node, at)], return_counts=True)
        part = (alone.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        rows = [(int(k), alone[part == k].tobytes(), times[part == k].astype("<i8").tobytes()) for k in np.unique(part)]
        columns = list(zip(*rows)) if rows else ((), (), ())
        return pa.table({"part": pa.array(columns[0], pa.int64()), "nodes": pa.array(columns[1], pa.binary()), "times": pa.array(columns[2], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        node, times = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<i8") for c in ("nodes", "times"))
        own, at = np.unique(node, return_inverse=True)
        return pa.table({"node": pa.array(own, pa.int64()), "alone": pa.array(np.bincount(at, times).astype(np.int64), pa.int64())})

    sent = docs.select("doc_id", "text").mapInArrow(send, fields("bucket long, names binary, units binary, nodes binary"))
    counted = sent.groupBy("bucket").applyInArrow(count, fields("part long, nodes binary, times binary"))
    return counted.groupBy("part").applyInArrow(add, fields("node long, alone long"))


def _units(member: DataFrame, percent: int) -> DataFrame:
    """(hub, a, b, node, root, size, most, cells): member's nodes of large hubs, in pairs of blocks (a, b) to be compared.

    Nodes are binned by size, by their share of unique elements, and by whether their root is the hub's most
    frequent one: at most a few hundred bins a hub, whatever its nodes. Pairs of bins whose sizes and bounds rule
    out similar sets, or of one root, go; bins are cut into blocks, and nodes are repeated for the blocks of the
    other bin of each pair that is left.
    """
    main = member.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    log = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(1 + BIN_PERCENT / 100))).cast("int")
    own = member.join(_by_part(main, member), ["hub", "part"])
    share = F.floor((F.col("size") - F.col("most")) * (100 // BIN_PERCENT) / F.col("size")).cast("int")
    bin_ = F.struct(log(F.col("size")).alias("size"), share.alias("share"), (F.col("root") == F.col("main")).alias("main"))
    own = written(own.select("hub", "node", "root", "size", "most", "cells", bin_.alias("bin")), "binned")

    bins = own.groupBy("hub", "bin").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("size").alias("size"), F.max("most").alias("most"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    bins = written(bins, "bins")
    x = bins.select("hub", *[F.col(c).alias(f"x_{c}") for c in bins.columns[1:]])
    y = bins.select("hub", *[F.col(c).alias(f"y_{c}") for c in bins.columns[1:]])
    possible = F.least("x_most", "y_most") * (100 + percent) >= percent * (F.col("x_size") + F.col("y_size"))
    mixed = (F.least("x_low", "y_low") < F.greatest("x_high", "y_high")) & (F.col("x_bin") <= F.col("y_bin"))
    pairs = x.join(y, "hub").where(mixed & possible).select("hub", "x_bin", "y_bin", "x_blocks", "y_blocks")
    count = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    pairs = pairs.withColumn("i", count("x_blocks")).withColumn("j", count("y_blocks")).where("x_bin < y_bin OR i <= j")
    code = lambda b, k: F.concat_ws(":", b["size"], b["share"], b["main"], k)
    pairs = pairs.select("hub", "x_bin", "i", "y_bin", "j", F.xxhash64(code(F.col("x_bin"), F.col("i"))).alias("a"), F.xxhash64(code(F.col("y_bin"), F.col("j"))).alias("b"))
    sides = pairs.select("hub", F.col("x_bin").alias("bin"), F.col("i").alias("block"), "a", "b").union(pairs.select("hub", "y_bin", "j", "a", "b")).distinct()
    placed = own.join(bins.select("hub", "bin", "blocks"), ["hub", "bin"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return placed.join(sides, ["hub", "bin", "block"]).select("hub", "a", "b", "node", "root", "size", "most", "cells")


def _shuffled(side: DataFrame) -> DataFrame:
    """A side that grows with the documents: its joins are shuffled at every size, so that small inputs show what large ones cost."""
    return side.hint("merge")


def _by_part(hubs: DataFrame, member: DataFrame) -> DataFrame:
    """hubs' rows, repeated for each part that member has of the hub, so that no task takes a whole hub."""
    parts = member.groupBy("hub").agg(F.max("part").alias("_parts"))
    return hubs.join(parts, "hub").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts")))).drop("_parts")


def classes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """docs' (doc_id, n_shingles, component_id): components of the graph of all pairs of rows that are similar."""
    return members(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def members(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """As `classes`, with each row's digest, node and component: the component's own key, null for empty sets.

    Sets that are equal are one node, known by a 64-bit hash like the shingles themselves; links between different
    sets are those that pass an exact test. In the bucket of a signature the node that is in most buckets is the
    hub. Each other one is tested against it, unless sizes or histograms rule it out: a row for each node and hub,
    not for each pair. What is left is nodes of one hub that are in different components. What two of them can share
    is bounded by the elements that are in no other set (most, the rest); nodes that this rules out go. Those
    of a small hub are one block, those of a large one are laid out as `_units` says; pairs are compared by bounds
    and histograms first, and the nodes that are left in a pair of blocks by their sets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = written(keyed(docs, n), "keyed")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("row")
    known = ids.where("node IS NOT NULL").groupBy("node").agg(row, F.first("n_shingles").alias("size"), F.first("cells").alias("cells"))
    known = known.select("node", F.col("row.doc_id").alias("least"), F.col("row.digest").alias("digest"), "size", "cells")
    known = written(known, "nodes")
    by_sig = Window.partitionBy("sig")
    shared = (
        signed(docs, n, percent)
        .withColumn("low", F.min("node").over(by_sig)).withColumn("high", F.max("node").over(by_sig))
        .where("low <> high").select("sig", "node").distinct()
    )
    shared = written(shared, "shared")
    degree = shared.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    hubs = shared.join(_shuffled(degree), "node").groupBy("sig").agg(F.max(F.struct("degree", "node"))["node"].alias("hub"), F.count(F.lit(1)).alias("nodes"))
    star = shared.join(_shuffled(hubs), "sig").where("node <> hub").groupBy("hub", "node").agg(F.max("nodes").alias("nodes"))
    star = written(star, "star")
    parts = written(star.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")), "hubs")
    star = written(star.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"), "parts")

    x = known.select("node", F.col("size").alias("x_size"), F.col("cells").alias("x_cells"))
    y = _by_part(known.select(F.col("node").alias("hub"), F.col("size").alias("y_size"), F.col("cells").alias("y_cells")), star)
    sizes = star.select("hub", "part", "node").join(_shuffled(x.drop("x_cells")), "node").join(_shuffled(y.drop("y_cells")), ["hub", "part"])
    sized = sizes.where(F.least("x_size", "y_size") * 100 >= percent * F.greatest("x_size", "y_size")).select("hub", "part", "node")
    close = written(sized.join(_shuffled(x), "node").join(_shuffled(y), ["hub", "part"]).mapInArrow(_possible(percent), fields("hub long, part int, node long")), "close")
    sets = written(node_sets(_rows_of(docs, known, close.select("node").union(close.select("hub"))), n), "sets")
    both = F.size(F.array_intersect("x", "y"))
    tested = (
        close.join(sets.select("node", F.col("elements").alias("x")), "node")
        .join(_by_part(sets.select(F.col("node").alias("hub"), F.col("elements").alias("y")), close), ["hub", "part"])
        .select("hub", "node", both.alias("both"), (F.size("x") + F.size("y")).alias("total"))
    )
    edges = tested.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    root = roots(edges)

    member = star.where("nodes > 2").select("hub", "part", "node").join(known.select("node", "size", "cells"), "node").join(root, "node", "left")
    member = written(member.select("hub", "part", "node", "size", "cells", F.coalesce("root", "node").alias("root")), "members")
    open_ = member.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("hub", "n")
    member = written(member.join(_by_part(open_, member), ["hub", "part"]), "open")
    total = known.agg(F.sum("size")).first()[0] or 0
    alone = written(_unique_elements(docs, n, total), "unique")
    bounded = member.join(alone, "node", "left").withColumn("most", F.col("size") - F.coalesce("alone", F.lit(0)))
    member = written(bounded.where(F.col("most") * 100 >= percent * F.col("size")).drop("alone"), "bounded")
    zero = F.lit(0).cast("bigint")
    units = member.where(F.col("n") <= BLOCK).select("hub", zero.alias("a"), zero.alias("b"), "node", "root", "size", "most", "cells")
    large = member.where(F.col("n") > BLOCK).drop("n")
    if not large.isEmpty():
        units = units.union(_units(large, percent))
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    sorted_units = units.repartition(int(shuffles), "hub", "a", "b").sortWithinPartitions("hub", "a", "b")
    left = written(sorted_units.mapInArrow(_open_units(percent), fields("hub long, a long, b long, node long, root long")), "left")
    more = left.join(written(node_sets(_rows_of(docs, known, left.select("node")), n), "sets"), "node").groupBy("hub", "a", "b").applyInPandas(_compared(percent), fields("a long, b long"))
    again = roots(more)
    final = root.join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = again.join(root, "node", "left_anti")  # nodes without a link to a hub
    final = final.union(alone.select("node", "root"))

    component = known.select("node", "least").join(final, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    of_root = component.groupBy("root").agg(F.min("least").alias("component_id"))
    component = written(component.join(of_root, "root").select("node", F.col("root").alias("component"), "component_id"), "components")
    columns = ["doc_id", "digest", "n_shingles", "node", "component", "component_id"]
    linked = ids.where("node IS NOT NULL").join(component, "node").select(columns)
    alone = ids.where("node IS NULL").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return linked.union(alone.select(columns))


def op9_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more, linked step by step.

    Null, empty and wordless texts have empty sets and are classes of their own; rows that repeat a doc_id are
    one class if their texts are alike; rows without doc_id are tested and linked like any other and take the
    least id of their class, null if no row of it has one. An empty table gives no rows.
    """
    return classes(table(spark, sf_dir, "documents"), 3, 90)


_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))

#: Sets as sorted lists of shingles, pairs by shared shingles, classes by reachability.
OP9_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' '))) END) AS k FROM w),
n AS MATERIALIZED (SELECT k, min(doc_id) AS node, len(k) AS n FROM s WHERE len(k) > 0 GROUP BY k),
e AS MATERIALIZED (SELECT node, n, unnest(k) AS g FROM n),
p AS MATERIALIZED (SELECT a.node AS x, b.node AS y FROM e a JOIN e b ON a.g = b.g AND a.node < b.node AND least(a.n, b.n) * 100 >= 90 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a AS node, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.k)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s LEFT JOIN n ON s.k = n.k LEFT JOIN c ON c.node = n.node
"""
