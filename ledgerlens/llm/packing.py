"""Packing of tokenized documents into windows by minimum bin slack.

Documents become id sequences that end in a separator; what exceeds a window is cut into full windows, the rest is a piece. Each task
keeps a pool of pieces as counts by length. A window takes the longest piece, and a subset-sum table, a bit set that holds every
reachable length, picks from the remaining multiset the pieces that come closest to the capacity; the counts per length are read back
from the table's history. When even the best choice leaves more than ``max_slack``, the longest piece is cut to fill the window and its
rest goes back. What is left at a task's end fills windows of power-of-two sizes, which need no padding.

The work is narrow: every partition packs its own rows in one pass, so there is no shuffle, no key that could be hot, and a lost
executor repeats only its own partitions (a retried task reads the same rows in the same order and numbers sequences alike). A task
wastes at most ``max_slack`` per window.

Defined cases: a null text is empty, an empty text is the separator alone; repeated rows and ids are packed like others.
Only the named columns are read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tokens import WordIds
from ledgerlens.llm.words import blocks, text_bytes

WINDOW = 4096
SEPARATOR = 2
#: Padding per window that is taken rather than cutting a document, and tokens in a task's pool before windows are filled.
MAX_SLACK, POOL = 16, 1 << 20
COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def best_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill ``capacity`` with the least slack. lengths: ascending, those with a count."""
    mask = (1 << (capacity + 1)) - 1
    reach, history = 1, []
    for i in range(bisect.bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[i]
        left, part = min(counts[length], capacity // length), 1
        while left:
            part = min(part, left)
            history.append((reach, length, part))
            reach |= (reach << (part * length)) & mask
            left -= part
            part *= 2
        if reach >> capacity & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, part in reversed(history):
        if not before >> at & 1:
            at -= part * length
            taken[length] = taken.get(length, 0) + part
    return taken


class Pool:
    """Pieces waiting for a window: (doc_id, start, bytes, doc_tokens) by length."""

    def __init__(self, first_id: int):
        self.pieces: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.tokens, self.next_id, self.out = 0, first_id, []

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        n = len(ids) // 4
        if n not in self.pieces:
            self.pieces[n], self.counts[n] = [], 0
            bisect.insort(self.lengths, n)
        self.pieces[n].append((doc_id, start, ids, doc_tokens))
        self.counts[n] += 1
        self.tokens += n

    def take(self, n: int) -> tuple:
        piece = self.pieces[n].pop()
        self.counts[n] -= 1
        self.tokens -= n
        if not self.counts[n]:
            del self.pieces[n], self.counts[n]
            self.lengths.remove(n)
        return piece

    def put(self, pieces: list[tuple]) -> None:
        """One sequence."""
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.out.append((doc_id, start, len(ids) // 4, doc_tokens, self.next_id, offset, ids))
            offset += len(ids) // 4
        self.next_id += 1

    def fill(self, capacity: int, max_slack: int) -> None:
        chosen = []
        room = capacity
        if self.lengths[-1] <= capacity:
            room -= self.lengths[-1]
            chosen.append(self.take(self.lengths[-1]))
        if room:
            for n, count in best_fill(self.lengths, self.counts, room).items():
                chosen += [self.take(n) for _ in range(count)]
                room -= n * count
        if room > max_slack and self.lengths:
            doc_id, start, ids, doc_tokens = self.take(self.lengths[-1])
            chosen.append((doc_id, start, ids[: 4 * room], doc_tokens))
            self.add(doc_id, start + room, ids[4 * room :], doc_tokens)
        self.put(chosen)

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def packed(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, separator: int = SEPARATOR,
    max_slack: int = MAX_SLACK,
) -> DataFrame:
    """A row per piece: doc_id, start (ids of its document before it), length, doc_tokens, sequence_id, offset in it, ids (bytes).

    Ids are unsigned 32-bit little-endian numbers. ``tokenizer``: a tokenizer file that every executor can read.
    """
    assert window > 0 and window & (window - 1) == 0, "the window is a power of two"
    end = separator.to_bytes(4, "little")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType

    def rows_of(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(COLUMNS)
        kinds = [ids, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=COLUMNS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer)
        pool = Pool(TaskContext.get().partitionId() << 40)
        ids_kind = None
        for batch in blocks(batches, "text"):
            ids_kind = batch.schema.field("doc_id").type
            data, bounds = text_bytes(batch.column("text"))
            texts = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for key, ids in zip(batch.column("doc_id").to_pylist(), words.encode_all(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    if len(part) == 4 * window:
                        pool.put([(key, start, part, n)])
                    else:
                        pool.add(key, start, part, n)
            while pool.tokens > POOL:
                pool.fill(window, max_slack)
            yield rows_of(pool.rows(), ids_kind)
        while pool.tokens >= window:
            pool.fill(window, max_slack)
        while pool.tokens:
            pool.fill(1 << (pool.tokens.bit_length() - 1), 0)
        if pool.out:
            yield rows_of(pool.rows(), ids_kind)

    return docs.mapInArrow(
        pack, f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
