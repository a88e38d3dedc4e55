"""Removal of repeated passages: longest-previous-factor arrays over suffixes that are sorted in bounded groups.

Windows are strings of `length` bytes. A sample of places, the anchors, is chosen by content so that equal windows have
equal anchors. Tasks exchange anchor hashes first; only stretches of text around anchors that are found in other
documents too are sorted, first within the task that has read them and what stays open then in groups by anchor.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import fields, from_planes, planes, small_batches, table, written

#: Bytes of a string that counts as repeated.
LENGTH = 50
#: Bytes of text whose anchors are found at once; longer texts are cut into chunks that overlap.
CHUNK = 2_500_000
#: Anchors that a task compares before it asks the others, and units (texts or chunks) among them at most.
ASKED, UNITS = 1_000_000, 60_000
#: Anchors, and windows, of a group that one task compares at a time.
GROUP_ANCHORS, GROUP_WINDOWS = 4_000_000, 2_500_000
#: Bytes of text whose removed spans are put together at a time.
GROUP_BYTES = 64_000_000
#: Windows that are sorted at once, or those of one anchor.
SORTED_WINDOWS = 1_000_000
#: Bits of an anchor's name. Anchors of equal names by chance cost work, not results.
NAME_BITS = 48

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64)
_powers: list[np.ndarray] = []


def _powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        _powers[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0][:n], _powers[1][:n]


def anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, segment, first, count) of runs of windows of `length` bytes that have the same anchor.

    A window's anchor is the place of the least hash of the shorter strings in it, so equal windows have anchors of equal
    names wherever they are, and windows of one anchor lie side by side. Segments are data[begins:ends], windows don't
    cross them.
    """
    half = max(1, 2 * length // 5)
    span = length - half + 1
    bits = np.uint64(max(1, (span - 1).bit_length()))
    n = len(data)
    windows = n - length + 1
    if windows < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    up, down = _powers_of_base(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * up, out=prefix[1:])
    key = (prefix[half:] - prefix[: n - half + 1]) * down[: n - half + 1]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    low = np.uint64((1 << int(bits)) - 1)
    place = np.arange(len(key), dtype=np.uint64)
    key = (key & ~low) | (place & low)
    least, width = key, 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: windows], least[span - width : span - width + windows])
    at = place[:windows] + ((least - place[:windows]) & low)
    new = np.empty(windows, bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    full = ends - begins >= length
    begins, last = begins[full], ends[full] - length + 1
    new[begins] = True
    first = np.flatnonzero(new)
    segment = np.searchsorted(begins, first, side="right") - 1
    inside = (segment >= 0) & (first < last[segment])
    first, segment = first[inside], segment[inside]
    count = np.minimum(np.append(first[1:], windows), last[segment]) - first
    name = (key[at[first].astype(np.int64)] >> bits) * np.uint64(0xC4CEB9FE1A85EC53)  # the least hashes crowd at the low end
    return (name ^ (name >> np.uint64(32))) * np.uint64(_BASE) >> np.uint64(64 - NAME_BITS), np.flatnonzero(full)[segment], first, count


# --- longest previous factors ----------------------------------------------------------------------------------


def _nearest_smaller(lcp: np.ndarray, value: np.ndarray, least: int) -> np.ndarray:
    """For each place the common prefix with the nearest place before it of a smaller value; 0 if that is below `least`.

    lcp[i] is that of i and i - 1. Each place follows the pointers of places whose value isn't smaller, which doubles its reach.
    """
    n = len(value)
    to = np.arange(-1, n - 1)
    reach = lcp.copy()
    reach[:1] = 0
    open_ = np.flatnonzero(reach >= least)
    short = reach < least
    to[short], reach[short] = -1, 0
    while len(open_):
        open_ = open_[value[to[open_]] >= value[open_]]
        via = to[open_]
        further, low = to[via], np.minimum(reach[open_], reach[via])
        low[further < 0] = 0
        low[low < least] = 0
        to[open_], reach[open_] = np.where(low > 0, further, -1), low
        open_ = open_[low > 0]
    return reach


def previous_factors(lcp: np.ndarray, value: np.ndarray, least: int) -> np.ndarray:
    """The longest prefix that each suffix shares with one of smaller value, from the previous and the next smaller in suffix order."""
    before = _nearest_smaller(lcp, value, least)
    back = np.append(lcp[1:], 0)[::-1].copy()  # lcp of i and i + 1, read from the end
    return np.maximum(before, _nearest_smaller(back, value[::-1], least)[::-1])


def _strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of bytes from data, filled up with zeros."""
    width = int(size.max())
    rows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(width, np.uint8)), width)[begin]
    rows[np.arange(width) >= size[:, None]] = 0
    return rows


def _suffix_order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def repeated_windows(data: np.ndarray, begin: np.ndarray, count: np.ndarray, name: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(flag of each window of each item, item that stands for each item).

    An item is the stretch of text of `count` windows that begins at `begin`; its flagged windows also start in an item of a smaller doc.
    First the suffixes that begin with items are sorted: their longest previous factors settle the windows
    inside. Of those not settled, one item stands for all of the same text and doc; where an anchor has several such texts,
    the suffixes at all their windows are sorted in the same way.
    """
    n, size = len(begin), count + length - 1
    if not n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    rows = _strings(data, begin, size)
    order = _suffix_order(rows)
    rows, sizes, docs = rows[order], size[order], doc[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]), np.minimum(sizes[1:], sizes[:-1]))
    same = np.zeros(n, bool)
    same[1:] = (lcp[1:] == sizes[1:]) & (sizes[1:] == sizes[:-1])
    factor = previous_factors(lcp, docs, length)
    settled = np.empty(n, np.int64)
    settled[order] = np.minimum(np.maximum(factor - length + 1, 0), sizes - length + 1)
    # of a run of equal texts, the open items are those of the least doc
    run = np.cumsum(~same) - 1
    open_ = np.flatnonzero(settled[order] < count[order])
    _, leader, member = np.unique(run[open_], return_index=True, return_inverse=True)
    stands = np.arange(n)
    stands[order[open_]] = order[open_[leader]][member]
    ends = np.cumsum(count)
    offset = ends - count
    window = np.arange(int(ends[-1])) - np.repeat(offset, count)
    flags = window < np.repeat(settled, count)
    texts = order[open_[leader]]
    _, of = np.unique(name[texts], return_inverse=True)
    least, most = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), np.iinfo(np.int64).min)
    np.minimum.at(least, of, doc[texts])
    np.maximum.at(most, of, doc[texts])
    several = least[of] < most[of]
    texts, of = texts[several], of[several]
    texts = texts[np.argsort(of, kind="stable")]
    cuts = _groups(np.sort(of))
    cuts = cuts[_groups((np.cumsum(count[texts]) - count[texts])[cuts] // SORTED_WINDOWS)] if len(cuts) else cuts
    views = np.lib.stride_tricks.sliding_window_view(data, length) if len(cuts) else None
    for own in np.split(texts, cuts[1:]) if len(cuts) else []:
        each = count[own]
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        rows = views[np.repeat(begin[own], each) + inner]
        order = _suffix_order(rows)
        rows = rows[order]
        lcp = np.zeros(len(rows), np.int64)
        lcp[1:] = np.where((rows[1:] == rows[:-1]).all(axis=1), length, 0)
        hit = np.empty(len(rows), bool)
        hit[order] = previous_factors(lcp, np.repeat(doc[own], each)[order], length) >= length
        flags[np.repeat(offset[own], each) + inner] |= hit
    if len(texts):
        changed = stands != np.arange(n)
        at = np.flatnonzero(np.repeat(changed, count))
        flags[at] |= flags[np.repeat(offset[stands], count)[at] + window[at]]
    return flags, stands


# --- what tasks exchange ---------------------------------------------------------------------------------------


_NO_REPLY = (1 << 16) - 1
_ROW = fields("bucket long, batch long, kind int, names binary, units binary, docs binary")
_KEYS = fields("doc_id long, digest long, has_id boolean")


def _row(bucket: int, batch: int, kind: int, names: bytes = b"", units: bytes = b"", docs: bytes = b"") -> tuple:
    return bucket, batch, kind, names, units, docs


def _out(rows: list[tuple], schema) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema)], names=schema.names)


def _groups(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


class _Texts:
    """Texts of a task, cut into units of CHUNK bytes at most, each (key, offset); equal keys of a batch are read once."""

    def __init__(self, length: int, chunk: int):
        self.length, self.chunk = length, chunk
        self.clear()

    def clear(self, *seen: tuple) -> None:
        """Begins a new batch; a key in `seen` is under way."""
        self.seen, self.units, self.parts, self.waiting = set(seen), [], [], 0

    def cut(self, key: tuple, text: bytes) -> Iterator[bool]:
        """Takes a text; yields whenever enough waits, and goes on in the same or the next batch."""
        if key in self.seen or len(text) < self.length:
            return
        self.seen.add(key)
        for offset in range(0, len(text) - self.length + 1, self.chunk):
            part = text[offset : offset + self.chunk + self.length - 1]
            self.units.append((key, offset))
            self.parts.append(part)
            self.waiting += len(part)
            if self.waiting >= self.chunk:
                yield True

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """data, where its units begin, and their anchors; units are numbered over the whole batch."""
        ends = np.cumsum([len(p) for p in self.parts])
        begins = ends - [len(p) for p in self.parts]
        data = np.frombuffer(b"".join(self.parts), np.uint8)
        name, segment, first, count = anchors(data, begins, ends, self.length)
        base = len(self.units) - len(self.parts)
        self.parts, self.waiting = [], 0
        return data, begins, name, segment + base, first, count


def _doc(key: tuple) -> int:
    """What documents are ordered by; one without an id comes after all others."""
    return key[0] if key[2] else np.iinfo(np.int64).max


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    ids = batch.column("doc_id")
    return list(zip(ids.fill_null(0).to_pylist(), batch.column("digest").to_pylist(), ids.is_valid().to_pylist()))


def _key_bytes(units: list[tuple[tuple, int]]) -> bytes:
    return np.array([(k[0], k[1], int(k[2]), offset) for k, offset in units], "<i8").tobytes()


def asked(docs: DataFrame, buckets: int, length: int, chunk: int) -> DataFrame:
    """For each bucket of names what each batch asks: a name once if several documents of the batch have it, else with its units.

    Row of kind 1: the units of the batch, and names that it knows to be shared.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        texts, found = _Texts(length, chunk), []

        def ask() -> list[tuple]:
            name, unit = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((unit, name))
            name, unit = name[order], unit[order]
            keep = np.append(True, (name[1:] != name[:-1]) | (unit[1:] != unit[:-1])) if len(name) else np.zeros(0, bool)
            name, unit = name[keep], unit[keep]
            out = [_row(((base >> 32) * 7919 + made) % buckets, base + made, 1, docs=_key_bytes(texts.units))]
            if len(name):
                doc = np.array([_doc(k) for k, _ in texts.units])[unit]
                at = _groups(name)
                size = np.diff(np.append(at, len(name)))
                several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                known = np.repeat(several, size)
                out[0] = out[0][:3] + (planes(name[known], 6), planes(unit[known], 2)) + out[0][5:]
                unit[at[several]] = _NO_REPLY
                sent = ~known
                sent[at[several]] = True
                name, unit = name[sent], unit[sent]
                bucket = (name * np.uint64(buckets)) >> np.uint64(NAME_BITS)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64))
                for k in range(buckets):
                    if cuts[k] < cuts[k + 1]:
                        own = slice(cuts[k], cuts[k + 1])
                        out.append(_row(k, base + made, 0, planes(name[own], 6), planes(unit[own], 2)))
            return out

        def waiting() -> int:
            return sum(len(x) for x, _ in found)

        for batch in rows:
            for key, text in zip(_keys(batch), batch.column("text").to_pylist()):
                for _ in texts.cut(key, text):
                    found.append(texts.anchors()[2:4])
                    if waiting() >= ASKED:
                        yield _out(ask(), _ROW)
                        made += 1
                        found = []
                        texts.clear(key)
                if len(texts.units) >= UNITS:
                    if texts.parts:
                        found.append(texts.anchors()[2:4])
                    yield _out(ask(), _ROW)
                    made += 1
                    found = []
                    texts.clear()
        if texts.parts:
            found.append(texts.anchors()[2:4])
        if found:
            yield _out(ask(), _ROW)

    return docs.mapInArrow(run, _ROW)


def _answer(group: pa.Table) -> pa.Table:
    """Of one bucket: to each batch its units' names that another batch has too, or that several documents of one have."""
    rows = group.to_pylist()
    out = [_row(0, r["batch"], 1, r["names"], r["units"], r["docs"]) for r in rows if r["kind"] == 1]
    rows = [r for r in rows if r["kind"] == 0]
    if rows:
        names, units = [from_planes(r["names"], 6) for r in rows], [from_planes(r["units"], 2).astype(np.int64) for r in rows]
        batch = np.repeat(np.arange(len(rows)), [len(x) for x in names])
        name, unit = np.concatenate(names), np.concatenate(units)
        order = np.argsort(name, kind="stable")
        name, unit, batch = name[order], unit[order], batch[order]
        at = _groups(name)
        shared = (np.minimum.reduceat(batch, at) != np.maximum.reduceat(batch, at)) | (np.maximum.reduceat(unit, at) == _NO_REPLY)
        told = np.repeat(shared, np.diff(np.append(at, len(name)))) & (unit != _NO_REPLY)
        name, unit, batch = name[told], unit[told], batch[told]
        order = np.argsort(batch, kind="stable")
        cuts = np.searchsorted(batch[order], np.arange(len(rows) + 1))
        for k, r in enumerate(rows):
            own = order[cuts[k] : cuts[k + 1]]
            if len(own):
                out.append(_row(0, r["batch"], 0, planes(name[own], 6), planes(unit[own], 2)))
    return pa.Table.from_batches([_out(out, _ROW)])


_NAMED = fields("doc_id long, digest long, has_id boolean, offset long, names binary")


def _by_unit(group: pa.Table) -> pa.Table:
    """Of one batch: the shared names of each unit."""
    rows = group.to_pylist()
    units = np.frombuffer(next(r["docs"] for r in rows if r["kind"] == 1), "<i8").reshape(-1, 4).tolist()
    name = np.concatenate([from_planes(r["names"], 6) for r in rows])
    unit = np.concatenate([from_planes(r["units"], 2) for r in rows]).astype(np.int64)
    order = np.lexsort((name, unit))
    name, cuts = name[order], np.searchsorted(unit[order], np.arange(len(units) + 1))
    out = [(d, g, bool(h), o, planes(name[cuts[k] : cuts[k + 1]], 6)) for k, (d, g, h, o) in enumerate(units) if cuts[k] < cuts[k + 1]]
    return pa.Table.from_batches([_out(out, _NAMED)])


# --- comparison ------------------------------------------------------------------------------------------------

_ITEMS = fields("bucket long, kind int, packed binary")


def _starts(flags: np.ndarray, count: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place in its document) of flagged windows."""
    item = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    return item[flags], (start[item] + window)[flags]


def _spans(starts: np.ndarray) -> np.ndarray:
    """Sorted starts as runs (first, how many)."""
    starts = np.unique(starts)
    if not len(starts):
        return np.zeros((0, 2), "<i8")
    first = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    return np.column_stack([starts[first], np.diff(np.append(first, len(starts)))]).astype("<i8")


def _hits(keys: list[tuple], unit: np.ndarray, place: np.ndarray, groups: int, spread: int) -> list[tuple]:
    """Rows of kind 1: the flagged starts of all documents of a group, by digest; groups are dealt to `spread` buckets."""
    order = np.lexsort((place, unit))
    unit, place = unit[order], place[order]
    at = np.append(_groups(unit), len(unit))
    by: dict[int, list] = {}
    for a, b in zip(at, at[1:]):
        key = keys[unit[a]]
        by.setdefault(key[1] % groups % spread, []).append((key, _spans(place[a:b])))
    return [(k, 1, _packed_hits(own)) for k, own in by.items()]


def _packed_hits(own: list[tuple[tuple, np.ndarray]]) -> bytes:
    head = np.array([(k[0], k[1], int(k[2]), len(spans)) for k, spans in own], "<i8")
    return len(own).to_bytes(8, "little") + head.tobytes() + b"".join(spans.tobytes() for _, spans in own)


def _unpacked_hits(data: bytes) -> Iterator[tuple[tuple, np.ndarray]]:
    n = int.from_bytes(data[:8], "little")
    head = np.frombuffer(data, "<i8", 4 * n, 8).reshape(-1, 4)
    spans = np.frombuffer(data, "<i8", offset=8 + 32 * n).reshape(-1, 2)
    ends = np.cumsum(head[:, 3])
    for (d, g, h, m), end in zip(head.tolist(), ends.tolist()):
        yield (d, g, bool(h)), spans[end - m : end]


_FOUND = fields("doc_id long, digest long, has_id boolean, found binary")


def _by_document(group: pa.Table) -> pa.Table:
    """Of one group of documents: all spans of each."""
    by: dict[tuple, list] = {}
    for data in group.column("packed").to_pylist():
        for key, spans in _unpacked_hits(data):
            by.setdefault(key, []).append(spans.tobytes())
    return pa.Table.from_batches([_out([(*key, b"".join(spans)) for key, spans in by.items()], _FOUND)])


def compared(joined: DataFrame, buckets: int, groups: int, length: int, chunk: int) -> DataFrame:
    """Within each task: kind 1, windows that an earlier document of the task holds; kind 0, by anchor, the stretches with others.

    Rows that repeat a stretch in one document are sent once, with all its starts.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, wanted = _Texts(length, chunk), []

        def compare() -> list[tuple]:
            units, number = texts.units, np.arange(len(texts.units))
            data, begins, name, unit, first, count = texts.anchors()
            tagged = np.concatenate([(np.uint64(k) << np.uint64(NAME_BITS)) | names for k, names in zip(number, wanted)])
            mine = np.isin((unit.astype(np.uint64) << np.uint64(NAME_BITS)) | name, tagged)
            name, unit, first, count = name[mine], unit[mine], first[mine], count[mine]
            doc = np.array([_doc(k) for k, _ in units])[unit]
            flags, stands = repeated_windows(data, first, count, name, doc, length)
            start = first - begins[unit] + np.array([o for _, o in units])[unit]
            keys = [k for k, _ in units]
            item, place = _starts(flags, count, start)
            out = _hits(keys, unit[item], place, groups, buckets)
            open_ = np.add.reduceat(~flags, np.cumsum(count) - count) > 0 if len(count) else np.zeros(0, bool)
            bucket = ((name * np.uint64(buckets)) >> np.uint64(NAME_BITS)).astype(np.int64)
            chosen = np.flatnonzero(open_)
            chosen = chosen[np.lexsort((unit[chosen], stands[chosen], bucket[chosen]))]
            at = np.append(_groups(bucket[chosen]), len(chosen))
            for a, b in zip(at, at[1:]):
                own = chosen[a:b]
                lead = _groups(stands[own])
                heads = own[lead]
                size = count[heads] + length - 1
                ends = np.cumsum(size)
                text = data[np.repeat(first[heads] - (ends - size), size) + np.arange(int(ends[-1]))]
                docs, local = np.unique(unit[own], return_inverse=True)
                packed = [
                    np.array([len(docs), len(heads), len(own)], "<i8").tobytes(), _key_bytes([(keys[u], 0) for u in docs]), planes(name[heads], 6), planes(count[heads], 1),
                    planes(np.diff(np.append(lead, len(own))), 4), planes(local, 3), planes(start[own], 6), text.tobytes(),
                ]
                out.append((int(bucket[own[0]]), 0, zlib.compress(b"".join(packed), 1)))
            return out

        for batch in rows:
            for key, text, found in zip(_keys(batch), batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                names = {f["offset"]: from_planes(f["names"], 6) for f in found}
                for _ in texts.cut(key, text):
                    wanted += [names.get(o, np.zeros(0, np.uint64)) for _, o in texts.units[len(wanted) :]]
                    yield _out(compare(), _ITEMS)
                    wanted = []
                    texts.clear(key)
                wanted += [names.get(o, np.zeros(0, np.uint64)) for _, o in texts.units[len(wanted) :]]
                if len(texts.units) >= UNITS:
                    yield _out(compare(), _ITEMS)
                    wanted = []
                    texts.clear()
        if texts.parts:
            yield _out(compare(), _ITEMS)

    return joined.mapInArrow(run, _ITEMS)


def _take(data: bytes, sizes: list[int]) -> list[bytes]:
    out, at = [], 0
    for n in sizes:
        out.append(data[at : at + n])
        at += n
    return [*out, data[at:]]


def _settle(groups: int, length: int):
    def settle(group: pa.Table) -> pa.Table:
        """Of one bucket: the windows that an earlier document of another task holds, besides what tasks found by themselves."""
        keys: list[tuple] = []
        number: dict[tuple, int] = {}
        parts, found = [], []

        def known(key: tuple) -> int:
            if key not in number:
                number[key] = len(keys)
                keys.append(key)
            return number[key]

        for kind, packed in zip(group.column("kind").to_pylist(), group.column("packed").to_pylist()):
            if kind == 1:
                for key, spans in _unpacked_hits(packed):
                    place = np.repeat(spans[:, 0] - (np.cumsum(spans[:, 1]) - spans[:, 1]), spans[:, 1]) + np.arange(spans[:, 1].sum())
                    found.append((np.full(len(place), known(key)), place))
                continue
            raw = zlib.decompress(packed)
            n_docs, n, m = np.frombuffer(raw[:24], "<i8").tolist()
            docs, name, count, times, local, start, text = _take(raw[24:], [32 * n_docs, 6 * n, n, 4 * n, 3 * m, 6 * m])
            own = np.array([known((d, g, bool(h))) for d, g, h, _ in np.frombuffer(docs, "<i8").reshape(-1, 4).tolist()])
            count = from_planes(count, 1).astype(np.int64)
            parts.append((np.frombuffer(text, np.uint8), from_planes(name, 6), count, from_planes(times, 4).astype(np.int64), own[from_planes(local, 3).astype(np.int64)], from_planes(start, 6).astype(np.int64)))
        if parts:
            text, name, count, times, unit, start = (np.concatenate(x) for x in zip(*parts))
            size = count + length - 1
            doc = np.array([_doc(k) for k in keys])[unit[np.cumsum(times) - times]]
            flags, _ = repeated_windows(text, np.cumsum(size) - size, count, name, doc, length)
            of = np.repeat(np.arange(len(count)), times)  # the item of each start
            ends = np.cumsum(count)
            each = count[of]
            inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            at, place = _starts(flags[np.repeat((ends - count)[of], each) + inner], each, start)
            found.append((unit[at], place))
        if not found:
            return pa.Table.from_batches([_out([], _ITEMS)])
        unit, place = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_batches([_out(_hits(keys, unit, place, groups, groups), _ITEMS)])

    return settle


# --- the operator ----------------------------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text): whole texts as bytes, null as empty; a row is known by its id and text."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("text")).withColumn("digest", F.xxhash64("text"))


def _by_key(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    own = found.select(F.when(F.col("has_id"), F.col("doc_id")).alias("_id"), F.col("digest").alias("_digest"), "found")
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), how).drop("_id", "_digest")


def repeated_spans(docs: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, digest, has_id, found) of rows of keyed docs with windows that also start in a document of a smaller id.

    found: runs (first, how many) of such starts as pairs of little-endian longs, in any order.
    """
    total = docs.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    asks = asked(docs, max(1, -(-total // (10 * GROUP_ANCHORS))), length, chunk)
    told = asks.groupBy("bucket").applyInArrow(_answer, _ROW).groupBy("batch").applyInArrow(_by_unit, _NAMED)
    names = told.groupBy("doc_id", "digest", "has_id", "offset").agg(F.first("names").alias("names"))
    found = written(names.groupBy("doc_id", "digest", "has_id").agg(F.collect_list(F.struct("offset", "names")).alias("found")), "shared-anchors")
    bytes_of = F.aggregate("found", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x["names"]))
    anchors_ = found.agg(F.sum(bytes_of).alias("n")).first().n or 0
    buckets, groups = max(1, -(-anchors_ * length // (18 * GROUP_WINDOWS))), max(1, -(-total // GROUP_BYTES))
    items = compared(_by_key(docs, found, "inner"), buckets, groups, length, chunk)
    hits = items.groupBy("bucket").applyInArrow(_settle(groups, length), _ITEMS).groupBy("bucket").applyInArrow(_by_document, _FOUND)
    return written(hits, "repeats")


_KEPT = fields("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of docs (doc_id, text).

    spans: the removed runs (first byte, how many) as pairs of little-endian longs. A document without an id comes
    after all others. Rows of one doc_id remove nothing of each other.
    """
    if not 4 <= length <= 160:
        raise ValueError("length is 4 to 160 bytes")
    if chunk < length:
        raise ValueError("a chunk is shorter than the strings")
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    spans = repeated_spans(rows, length, chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                if not found:
                    out.append((doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest(), b""))
                    continue
                runs = np.frombuffer(found, "<i8").reshape(-1, 2)
                runs = runs[np.argsort(runs[:, 0], kind="stable")]
                ends = np.maximum.accumulate(runs[:, 0] + runs[:, 1] - 1 + length)
                new = np.flatnonzero(np.append(True, runs[1:, 0] > ends[:-1]))
                a, b = runs[new, 0], ends[np.append(new[1:] - 1, len(ends) - 1)]
                kept, at = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept.update(text[at:x])
                    at = y
                kept.update(text[at:])
                out.append((doc_id, len(text), int((b - a).sum()), len(a), kept.hexdigest(), np.column_stack([a, b - a]).astype("<i8").tobytes()))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=_KEPT.names)

    return _by_key(rows, spans, "left").mapInArrow(run, _KEPT)


def op12_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that a document of a smaller doc_id holds too.

    Null and empty texts have no bytes and lose none. Rows that repeat a doc_id are cut each, and not by each other;
    rows without doc_id come last. Very long texts are compared whole, in overlapping chunks. Other columns aren't read. An empty table
    gives no rows.
    """
    return without_repeats(table(spark, sf_dir, "documents")).drop("spans")


#: Strings as hex digits: the least document that has each, runs of starts that overlap or touch, and what lies between them.
OP12_SQL = f"""
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS i FROM t)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH}, true)::INT AS new FROM m)),
r AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM r GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(n_spans + 1), lambda j: substr(h, 2 * coalesce(ends[j], 0) + 1, 2 * (coalesce(starts[j + 1], length(h) // 2) - coalesce(ends[j], 0)))), '') END)) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
