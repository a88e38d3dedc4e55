"""Vector bin packing of examples into sequences with limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from freshet.llm.common import fields, small_batches, table
from freshet.llm.tokens import END_ID, batches, crc32, encoded

TOKENIZER = "word_bpe_49k.json"
SEQUENCE_TOKENS = 4096
#: Unless limits are given, a sequence holds at most so many times the segments of a mean one of what is left to pack, and of the tokens that
#: bear no loss in a mean one it has at least this share.
MOST_SEGMENTS, LEAST_PLAIN = 1.25, 0.5
#: Examples and tokens among which a task looks for the next to place. Both bound its memory.
POOL_EXAMPLES = 768
POOL_TOKENS = 750_000
#: A pool of fewer tokens waits for more examples, so that short ones fill whole sequences.
LEAST_POOL_TOKENS = 8 * SEQUENCE_TOKENS
#: A piece isn't cut to fill fewer tokens than this.
LEAST_CUT = 16
#: In plain documents a first token has no context to be predicted from, so it bears no loss.
PROMPT_TOKENS = 1


class Packer:
    """Fills one sequence after another from a pool of pieces.

    Of the pieces that fit, the next is the one with the largest dot product of its demand, brought to length 1, and what the sequence
    has left, each as a share of its limit and weighted by the pool's mean demand: what is left of all limits runs out together. If none fits, a longer one is
    cut: its head fills the sequence and its tail goes back. So does what takes the last segment. Pieces of a whole sequence's
    length don't compete. Pieces of equal demand are one kind, the last of which is taken first. Limits on segments and loss that
    aren't given follow the pieces that are left, anew for each sequence: short documents are spread over the sequences and not
    kept for the last ones, and pools of the shortest still fill whole sequences.
    """

    def __init__(self, tokens: int = SEQUENCE_TOKENS, segments: int | None = None, loss: int | None = None):
        if min(tokens, 1 if segments is None else segments, 1 if loss is None else loss) < 1:
            raise ValueError("limits must be positive")
        self.tokens, self.segments, self.most_loss = tokens, segments, loss
        self.pool: list[tuple[int, int, int, int]] = []  # example, start, length, tokens of the example without loss

    @staticmethod
    def loss(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def add(self, example: int, length: int, prompt: int) -> Iterator[list[tuple[int, int, int]]]:
        """Takes an example; yields the sequences that it fills alone."""
        start, whole = 0, self.tokens
        while length - start >= whole and (self.most_loss is None or self.loss(start, whole, prompt) <= self.most_loss):
            yield [(example, start, whole)]
            start += whole
        if start < length:
            self.pool.append((example, start, length - start, prompt))

    def limits(self, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of tokens, segments and loss in the next sequence, for so many pieces (count) of each demand (size). A piece may always be alone."""
        total = count @ size
        each = self.tokens / total[0]
        segments = np.ceil(MOST_SEGMENTS * total[1] * each) if self.segments is None else self.segments
        loss = np.ceil(self.tokens - LEAST_PLAIN * (total[0] - total[2]) * each) if self.most_loss is None else self.most_loss
        if self.most_loss is None:
            loss = max(loss, size[count > 0, 2].max())
        return np.array([self.tokens, min(segments, self.tokens) if self.segments is None else segments, max(loss, 1)], np.float64)

    def sequences(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Full sequences from the pool; with last, all that is left. Otherwise a part-filled one goes back."""
        pieces, self.pool = self.pool, []
        place: dict[tuple[int, int, int], int] = {}  # of each kind of demand
        stacks: list[list[tuple[int, int, int, int]]] = []
        size, count = np.ones((2 * len(pieces) + 8, 3)), np.zeros(2 * len(pieces) + 8)

        def put(piece: tuple[int, int, int, int]) -> None:
            nonlocal size, count
            demand = (piece[2], 1, self.loss(*piece[1:]))
            k = place.setdefault(demand, len(stacks))
            if k == len(stacks):
                stacks.append([])
                if k >= len(size):
                    size, count = np.vstack([size, np.ones_like(size)]), np.concatenate([count, np.zeros_like(count)])
                size[k] = demand
            stacks[k].append(piece)
            count[k] += 1

        for piece in pieces:
            put(piece)
        while count.any():
            here = np.flatnonzero(count)
            limits = self.limits(size[here], count[here])
            demands, share = size[here], size[here] / limits
            weight = count[here] @ share / count.sum()
            toward = share / np.sqrt((share * share * weight).sum(axis=1))[:, None]
            left, chosen, tails, open_ = limits.copy(), [], [], np.ones(len(here), bool)

            def take(pick: int) -> tuple[int, int, int, int]:
                k = here[pick]  # noqa: B023
                count[k] -= 1
                open_[pick] = count[k] > 0  # noqa: B023
                return stacks[k].pop()

            while True:
                fits = open_ & (demands <= left).all(axis=1)
                if left[1] == 1 and left[0] >= LEAST_CUT and (open_ & (demands[:, 0] > left[0])).any():
                    fits[:] = False
                if fits.any():
                    pick = int(np.argmax(np.where(fits, toward @ (weight * left / limits), -1.0)))
                    chosen.append(take(pick))
                    left -= demands[pick]
                    continue
                if left[0] < LEAST_CUT or left[1] < 1 or not open_.any():
                    break
                pick = int(np.argmax(np.where(open_, demands[:, 0], -1.0)))
                example, start, n, prompt = stacks[here[pick]][-1]
                head = int(min(left[0], n - 1, max(prompt - start, 0) + left[2]))
                if head < LEAST_CUT:
                    break
                take(pick)
                chosen.append((example, start, head, prompt))
                left -= (head, 1, self.loss(start, head, prompt))
                tails.append((example, start + head, n - head, prompt))
            for piece in tails:
                put(piece)
            if not last and not count.any() and left[0] >= LEAST_CUT and left[1] >= 1:
                self.pool = chosen
                return
            yield [piece[:3] for piece in chosen]


PIECES = fields("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, tokens: int = SEQUENCE_TOKENS, segments: int | None = None, loss: int | None = None) -> DataFrame:
    """The pieces of all rows of docs (doc_id, text), packed by the tasks that read them; no shuffle.

    Each task fills sequences from a pool of bounded size and leaves at most one part-filled. sequence_id holds the
    task's number in its upper half. Null and empty texts are the end id alone; repeated rows are packed each.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(tokens, segments, loss), {}
        task, made, seen, waiting = TaskContext.get().partitionId() << 32, 0, 0, 0

        def emit(sequences) -> Iterator[pa.RecordBatch]:
            nonlocal made
            out = []
            for pieces in sequences:
                offset = 0
                for example, start, n in pieces:
                    doc_id, ids, left = held[example]
                    out.append((doc_id, start, n, crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, task + made, offset))
                    offset += n
                    if left == n:
                        del held[example]
                    else:
                        held[example] = (doc_id, ids, left - n)
                made += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=PIECES.names)

        end = END_ID.to_bytes(4, "little")
        for batch in rows:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in batches(texts, 6_000_000):
                for doc_id, ids in zip(doc_ids[a:b], encoded(path, texts[a:b])):
                    ids += end
                    held[seen] = (doc_id, ids, len(ids) // 4)
                    yield from emit(packer.add(seen, len(ids) // 4, PROMPT_TOKENS))
                    seen += 1
                    waiting += len(ids) // 4
                    if waiting >= POOL_TOKENS or (len(packer.pool) >= POOL_EXAMPLES and waiting >= LEAST_POOL_TOKENS):
                        yield from emit(packer.sequences(last=False))
                        waiting = 0
        yield from emit(packer.sequences(last=True))

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens.

    Null and empty texts are the end id alone; very long texts fill sequences of their own and their rest is packed; rows that repeat a
    doc_id are packed each, and equal demands are taken last come, first served. Other columns aren't read. An empty table gives no rows.
    """
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
