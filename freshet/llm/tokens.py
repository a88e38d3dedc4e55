"""Token ids of whole texts with the tokenizers library, by pieces that are encoded once and then remembered."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Pieces in each of a worker's two generations of memory; when the newer is full, the older goes.
REMEMBERED = 400_000
#: Longer pieces aren't remembered.
PIECE_CHARS = 48
#: Pieces that are encoded as one text.
JOINED = 300
#: Marks a piece that begins a text or follows another without a space; no split text holds it.
FIRST = "\0"
#: After a letter or digit these always begin another token.
_PUNCTUATION = ".,;:!?#$%&*|"
#: A space after another space character could be part of a token with it; such texts are encoded whole.
_SPACES = "".join(f"\\x{{{i:x}}}" for i in range(0x3001) if chr(i).isspace()) + "\\x{180e}\\x{feff}\\x{200b}"
_UNSAFE = f"[{_SPACES}] |\\x{{0}}"
#: Plain words: ASCII and Latin-1 letters, of which any number can be encoded as one text.
_WORDS = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{{1,{PIECE_CHARS}}}$"


def _latin(text: str) -> bool:
    """Whether all letters have a lower case of one character, the same for Python and the tokenizers."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Memory:
    """A tokenizer and the ids of pieces that this worker has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.any_case = self.whole("A b") == self.whole("a B")
        # Tokens that begin a word after a space, or else those that end a word.
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        end = self.tokenizer.model.end_of_word_suffix
        self.marks = np.zeros(max(names.values()) + 1, bool)
        self.marks[[i for x, i in names.items() if (x.endswith(end) if end else x[0] == "\u0120")]] = True
        self.marks_end = bool(end)

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def words(self, names: list[str]) -> list[bytes]:
        """The ids of plain words that follow a space."""
        ids = list(map(self.known.get, names))
        if missing := [x for x, y in zip(names, ids) if y is None]:
            self.turn()
            found = dict(zip(missing, map(self.older.get, missing)))
            self.encode([], [x for x, y in found.items() if y is None], found)
            self.known.update(found)
            ids = [found[x] if y is None else y for x, y in zip(names, ids)]
        return ids

    def pieces(self, names: list[str]) -> list[bytes]:
        """The ids of any pieces, as `learn` takes them."""
        ids = list(map(self.known.get, names))
        if missing := [x for x, y in zip(names, ids) if y is None]:
            found = self.learn(missing)
            ids = [found[x] if y is None else y for x, y in zip(names, ids)]
        return ids

    def turn(self) -> None:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't in the newer generation. A piece follows a space unless it begins with FIRST."""
        self.turn()
        older, known = self.older.get, self.known
        found: dict[str, bytes] = {}
        parts: list[tuple[str, str, str]] = []
        todo: set[str] = set()
        for piece in pieces:
            ids = older(piece)
            if ids is not None:
                found[piece] = ids
                continue
            stem = piece.rstrip(_PUNCTUATION)
            if stem == piece or not stem or not stem[-1].lower()[-1].isalnum():
                todo.add(piece)
                continue
            tail = FIRST + piece[len(stem) :]
            parts.append((piece, stem, tail))
            for x in (stem, tail):
                if x not in known and x not in found and x not in todo:
                    ids = older(x)
                    if ids is None:
                        todo.add(x)
                    else:
                        found[x] = ids
        alpha = [x.isalpha() and x.lower().isalpha() and len(x) < 100 for x in todo]
        self.encode([x for x, y in zip(todo, alpha) if not y], [x for x, y in zip(todo, alpha) if y], found)
        for piece, stem, tail in parts:
            found[piece] = (found[stem] if stem in found else known[stem]) + (found[tail] if tail in found else known[tail])
        known.update(x for x in found.items() if len(x[0]) <= PIECE_CHARS)
        return found

    def encode(self, rest: list[str], words: list[str], found: dict[str, bytes]) -> None:
        """Words of letters after a space are encoded many at a time, as one text, and told apart by their first or last tokens."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for i in range(0, len(groups), 16):
            own = groups[i : i + 16]
            for group, e in zip(own, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in own], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                at = np.flatnonzero(self.marks[ids])
                if len(at) != len(group):
                    rest += group
                    continue
                cuts = [0, *((at + 1) * 4).tolist()] if self.marks_end else [*(at * 4).tolist(), 4 * len(ids)]
                data = ids.tobytes()
                for k, x in enumerate(group):
                    found[x] = data[cuts[k] : cuts[k + 1]]
        for i in range(0, len(rest), 5000):
            own = rest[i : i + 5000]
            plain = [x[1:] if x[:1] == FIRST else " " + x for x in own]
            for x, e in zip(own, self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)):
                found[x] = _packed(e.ids)


_LOADED: dict[str, Memory] = {}


def loaded(path: str) -> Memory:
    if path not in _LOADED:
        _LOADED[path] = Memory(path)
    return _LOADED[path]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _piece_ids(memory: Memory, pieces: pa.Array) -> pa.Array:
    """The ids of pieces that follow a space; a plain word and one punctuation mark after it are looked up apart."""
    stems = pc.utf8_rtrim(pieces, characters=_PUNCTUATION)
    size = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
    tail = size - pc.binary_length(stems).to_numpy(zero_copy_only=False)
    plain = (tail <= 1) & pc.match_substring_regex(stems, _WORDS).to_numpy(zero_copy_only=False)
    _, offsets, data = pieces.buffers()
    ends = np.frombuffer(offsets, np.int32)[pieces.offset + 1 : pieces.offset + 1 + len(pieces)]
    ended = np.flatnonzero(plain & (tail == 1))
    marks = np.frombuffer(data, np.uint8)[ends[ended] - 1] if len(ended) else np.zeros(0, np.uint8)
    own = pc.dictionary_encode(stems.filter(pa.array(plain)))
    words = memory.words(own.dictionary.to_pylist())
    known = memory.pieces(pieces.filter(pa.array(~plain)).to_pylist())
    after = memory.pieces([FIRST + chr(c) for c in np.unique(marks).tolist()])
    values = pa.array([b"", *words, *known, *after], pa.large_binary())
    pair = np.zeros((len(pieces), 2), np.int64)
    pair[plain, 0] = 1 + own.indices.to_numpy()
    pair[~plain, 0] = 1 + len(words) + np.arange(len(known))
    pair[ended, 1] = 1 + len(words) + len(known) + np.searchsorted(np.unique(marks), marks)
    _, offsets, data = values.take(pa.array(pair.ravel())).buffers()
    cuts = np.frombuffer(offsets, np.int64)[: 2 * len(pieces) + 1 : 2].copy()
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(cuts), data])


def encoded(path: str, texts: list[str | None]) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, without special tokens; None counts as empty.

    Both public tokenizers split a text before each single space that follows no space, so the ids of a text are
    those of its pieces, which the library encodes and this worker remembers.
    """
    memory = loaded(path)
    out: list[bytes] = [b""] * len(texts)
    unsafe = pc.match_substring_regex(pa.array(texts, pa.string()), _UNSAFE).to_pylist()
    safe: list[int] = []
    for i, text in enumerate(texts):
        if text and unsafe[i]:
            out[i] = memory.whole(text)
        elif text:
            safe.append(i)
    if not safe:
        return out
    own = [t.lower() if memory.any_case and _latin(t) else t for t in (texts[i] for i in safe)]
    lists = pc.split_pattern(pa.array(own, pa.string()), " ")
    coded = pc.dictionary_encode(lists.values)
    begins = lists.offsets.to_numpy().astype(np.int64)
    ids = _piece_ids(memory, coded.dictionary)
    index = coded.indices.to_numpy().copy()
    n = len(ids)
    first = memory.pieces([FIRST + t.split(" ", 1)[0] for t in own])
    index[begins[:-1]] = np.arange(n, n + len(first))  # the first piece of a text follows no space
    ids = pa.concat_arrays([ids, pa.array(first, pa.large_binary())])
    taken = ids.take(pa.array(index))
    _, offsets, data = taken.buffers()
    data = data.to_pybytes()
    cuts = np.frombuffer(offsets, np.int64)[begins].tolist()
    for k, i in enumerate(safe):
        out[i] = data[cuts[k] : cuts[k + 1]]
    return out


def batches(texts: list, chars: int = 4_000_000):
    """Index ranges of about `chars` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


@cache
def _zero_bytes(power: int) -> list[int]:
    """The operator that appends 2**power zero bytes to what a CRC-32 has seen, as a matrix over GF(2)."""
    if power:
        half = _zero_bytes(power - 1)
        return [_times(half, row) for row in half]
    matrix = [0xEDB88320, *[1 << i for i in range(31)]]  # a zero bit
    for _ in range(3):
        matrix = [_times(matrix, row) for row in matrix]
    return matrix


def crc32_shifted(crc: int, n_bytes: int) -> int:
    """What a CRC-32 adds to that of its bytes followed by n_bytes more; the CRC of a whole is the XOR of its parts'.

    Applies an operator for each bit of n_bytes; a worker makes each of them once.
    """
    power = 0
    while n_bytes:
        if n_bytes & 1:
            crc = _times(_zero_bytes(power), crc)
        n_bytes >>= 1
        power += 1
    return crc


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
