"""Vectorised reading of words from Arrow text columns, shared by the operators of this package.

A text column is one byte buffer; words, their hashes and their documents come from a few array passes
over it, so no Python object is made per word. Work is cut into blocks of a few megabytes of text; a text
longer than that forms a block of its own and stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerlens.session import scratch_path

BLOCK_BYTES = 1 << 20


def byte_table(separators: list[tuple[int, int]], lower: bool) -> np.ndarray:
    """256 entries: 0 for a separator, else a byte (A-Z lowered if asked)."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255  # a zero byte is a word character unless listed; 255 never occurs in UTF-8
    if lower:
        table[65:91] += 32
    for first, last in separators:
        table[first : last + 1] = 0
    return table


#: Words are what stands between ASCII white space.
SPACE_LOWER = byte_table([(0x20, 0x20), (0x09, 0x0D)], lower=True)
SPACE_EXACT = byte_table([(0x20, 0x20), (0x09, 0x0D)], lower=False)
#: Words are runs of letters, digits and non-ASCII characters, A-Z lowered (A-Z stands at 0x41-0x5A and is a letter).
LETTER_LOWER = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], lower=True)

_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LEN, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: every output bit depends on every input bit, one to one."""
    x = x ^ (x >> _S33)
    x *= _C1
    x ^= x >> _S33
    x *= _C2
    x ^= x >> _S33
    return x


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one per word
    starts: np.ndarray  # byte positions in the block
    ends: np.ndarray
    offsets: np.ndarray  # words of document i: offsets[i] to offsets[i + 1]

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their bounds; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if bounds else np.zeros(1, np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def spans_of(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; no run crosses a document's bound."""
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[bounds[:-1][bounds[:-1] < len(inside)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, read eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left = ends - starts
    out = mix((eight[starts] & _MASK[np.minimum(left, 8)]) + left.astype(np.uint64) * _LEN)
    todo = np.flatnonzero(left > 8)
    at, left = starts[todo] + 8, left[todo] - 8
    while len(todo):
        out[todo] = mix(out[todo] * _STEP + (eight[at] & _MASK[np.minimum(left, 8)]))
        on = left > 8
        todo, at, left = todo[on], at[on] + 8, left[on] - 8
    return out


def words_of(column: pa.Array, table: np.ndarray) -> Words:
    data, bounds = text_bytes(column)
    if not len(data):
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64))
    data = table[data]
    starts, ends = spans_of(data != 0, bounds)
    return Words(hash_spans(data, starts, ends), starts, ends, np.searchsorted(starts, bounds))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and the word positions where n words are left in the document.

    The hashes are aligned with those positions.
    """
    size = len(words.hashes)
    left = np.repeat(words.offsets[1:], np.diff(words.offsets)) - np.arange(size)
    at = np.flatnonzero(left >= n)
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out * _STEP + words.hashes[at + j]
    return mix(out + np.uint64(n)), at


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows again, cut so that a block holds few megabytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + BLOCK_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder: later steps read them and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
