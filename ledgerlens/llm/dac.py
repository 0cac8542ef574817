"""Token ids in files of directly addressable codes.

An id is split into chunks from its low bits up. Level 0 holds the first chunk of every id, level k the next chunk of those ids that are not
finished below it; a bitmap per level tells which ids go on, and a rank directory (set bits before each 512th place) leads from
a place of one level to its place in the next by one look-up and a count of at most 511 bits. So any id, or any range of ids,
is read from a few bytes of each level, without decoding what lies before it.

A file: ``DAC1``, the length of a JSON head, the head (chunk widths, sections with places and sizes), then the sections: first id
of each document and their end, document ids (an Arrow stream), and per level chunks, bitmap and directory.

Rows are ordered by document id by a range sort; rows of equal id keep the order of the input's partitions, and as the order has a row
number, an id that is in very many rows is divided among tasks. Each task writes its rows into files of at most ``FILE_TOKENS`` ids (a longer
document is a file of its own). The list of files is a table that holds only what successful tasks wrote; where a file begins in the whole
sequence is a prefix sum over that list in two levels.

Defined cases: a null or empty text has its end id alone; a null document id comes first; repeated rows are documents of their own; an empty
table gives no files. Only the named columns are read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.byte_tokens import ByteWordIds, spread
from ledgerlens.llm.separators import file_system
from ledgerlens.llm.words import blocks, written
from ledgerlens.session import scratch_path

#: Bits of the chunks; they add up to 32.
WIDTHS = (8, 8, 16)
#: Ids in a file, and ids that a task decodes at once.
FILE_TOKENS, READ_TOKENS = 1 << 25, 1 << 20
#: Places per entry of a rank directory.
RANKED = 512
#: Files of a group of the prefix sum, positions of a bucket of the look-up.
GROUP, BUCKET = 1024, 1 << 24
MAGIC = b"DAC1"
FILES = "path string, part long, no long, documents long, tokens long"


def split(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chunks of each level, and which of them go on in the next."""
    out = []
    for k, width in enumerate(widths):
        kind = np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32
        more = ids >> np.uint32(width) if width < 32 else np.zeros_like(ids)
        on = more > 0
        out.append(((ids & np.uint32((1 << width) - 1)).astype(kind), on))
        assert k < len(widths) - 1 or not on.any(), "ids are wider than the chunks"
        ids = more[on]
    return out


class Writer:
    """Collects documents and gives the bytes of a file; holds chunks and bits, not ids."""

    def __init__(self, widths: tuple[int, ...] = WIDTHS):
        assert sum(widths) == 32
        self.widths, self.levels = widths, [([], []) for _ in widths]
        self.lengths, self.keys, self.tokens = [], [], 0

    def add(self, keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys)
        self.lengths.append(lengths)
        self.tokens += len(ids)
        for (chunks, bits), (c, on) in zip(self.levels, split(ids, self.widths), strict=True):
            chunks.append(c)
            bits.append(on)

    def documents(self) -> int:
        return sum(map(len, self.lengths))

    def sections(self) -> Iterator[tuple[str, bytes]]:
        starts = np.concatenate([[0], *self.lengths]).cumsum()
        yield "starts", starts.astype("<u8").tobytes()
        sink = pa.BufferOutputStream()
        batch = pa.Table.from_arrays([pa.chunked_array(self.keys)], names=["doc_id"]).combine_chunks()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_table(batch)
        yield "doc_ids", sink.getvalue().to_pybytes()
        for k, (chunks, bits) in enumerate(self.levels):
            values, on = np.concatenate(chunks), np.concatenate(bits)
            yield f"chunks{k}", values.astype(values.dtype.newbyteorder("<")).tobytes()
            if k < len(self.levels) - 1:
                words = np.zeros(-(-len(on) // RANKED) * RANKED // 8, np.uint8)
                words[: -(-len(on) // 8)] = np.packbits(on, bitorder="little")
                ones = np.bitwise_count(words.reshape(-1, RANKED // 8)).sum(axis=1, dtype=np.uint64)
                yield f"bits{k}", words.tobytes()
                yield f"ranks{k}", np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)]).astype("<u8").tobytes()

    def bytes(self) -> bytes:
        parts, places, at = [], {}, 0
        for name, data in self.sections():
            places[name] = (at, len(data))
            parts.append(data)
            at += len(data)
        head = json.dumps({"widths": self.widths, "tokens": self.tokens, "documents": self.documents(), "sections": places}).encode()
        return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *parts])


class Reader:
    """Reads documents, ranges and single ids. ``source``: an open file with ``read_at(size, offset)``."""

    def __init__(self, source):
        self.source = source
        magic = source.read_at(8, 0)
        if magic[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        size = int.from_bytes(magic[4:], "little")
        head = json.loads(source.read_at(size, 8))
        self.widths, self.tokens, self.documents = tuple(head["widths"]), head["tokens"], head["documents"]
        self.places = {name: (8 + size + at, length) for name, (at, length) in head["sections"].items()}

    def part(self, name: str, kind: str, first: int, count: int) -> np.ndarray:
        """``count`` numbers of a section from number ``first`` on."""
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.source.read_at(count * width, self.places[name][0] + first * width), kind)

    def starts(self) -> np.ndarray:
        return self.part("starts", "<u8", 0, self.documents + 1).astype(np.int64)

    def doc_ids(self) -> pa.ChunkedArray:
        at, length = self.places["doc_ids"]
        return pa.ipc.open_stream(self.source.read_at(length, at)).read_all().column(0)

    def rank(self, level: int, place: int) -> int:
        """Ids that go on before ``place``."""
        block = place // RANKED
        bits = self.part(f"bits{level}", "u1", block * RANKED // 8, -(-(place - block * RANKED) // 8))
        return int(self.part(f"ranks{level}", "<u8", block, 1)[0]) + int(np.unpackbits(bits, bitorder="little")[: place - block * RANKED].sum())

    def range(self, first: int, to: int) -> np.ndarray:
        """The ids at the places first to to - 1."""
        if not 0 <= first <= to <= self.tokens:
            raise IndexError(f"{first} to {to} of {self.tokens}")
        out = np.zeros(to - first, np.uint32)
        where, shift = np.arange(to - first), 0
        for level, width in enumerate(self.widths):
            if first == to:
                break
            kind = "u1" if width <= 8 else "<u2" if width <= 16 else "<u4"
            out[where] |= self.part(f"chunks{level}", kind, first, to - first).astype(np.uint32) << np.uint32(shift)
            if level < len(self.widths) - 1:
                bits = self.part(f"bits{level}", "u1", first // 8, -(-to // 8) - first // 8)
                on = np.unpackbits(bits, bitorder="little")[first % 8 : first % 8 + to - first].astype(bool)
                first, where, shift = self.rank(level, first), where[on], shift + width
                to = first + len(where)
        return out

    def at(self, positions: np.ndarray, near: int = 4096) -> np.ndarray:
        """The ids at any places; places within ``near`` of each other share a reading."""
        order = np.argsort(positions, kind="stable")
        sorted_ = positions[order]
        out = np.zeros(len(positions), np.uint32)
        cuts = np.flatnonzero(np.diff(sorted_) > near) + 1
        for group, places in zip(np.split(order, cuts), np.split(sorted_, cuts), strict=True):
            if len(places):
                out[group] = self.range(int(places[0]), int(places[-1]) + 1)[places - places[0]]
        return out


def write_files(
    docs: DataFrame, folder: str, tokenizer: str, end: int = 0, doc_id: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS,
    widths: tuple[int, ...] = WIDTHS,
) -> DataFrame:
    """Writes the ids of each text and the id ``end`` behind it, in ascending order of the documents. Returns the list of files, which is stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        words, part, no = ByteWordIds.of(tokenizer), TaskContext.get().partitionId(), 0
        system.create_dir(root, recursive=True)
        writer = Writer(widths)

        def finished() -> pa.RecordBatch:
            name = f"ids-{part:06d}-{no:04d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(writer.bytes())
            return pa.RecordBatch.from_pylist([{"path": name, "part": part, "no": no, "documents": writer.documents(), "tokens": writer.tokens}])

        for batch in blocks(batches, "text"):
            ids, bounds = words.encode(batch.column("text"))
            ends = bounds[1:] + np.arange(1, len(bounds))  # with the end ids
            all_ids = np.full(int(ends[-1]), end, np.uint32)
            lengths = np.diff(bounds)
            all_ids[spread(ends - 1 - lengths, lengths)] = ids
            at, base = 0, 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, base + file_tokens - writer.tokens, "right")))
                if writer.tokens and ends[to - 1] - base + writer.tokens > file_tokens:
                    yield finished()
                    writer, no = Writer(widths), no + 1
                    continue
                writer.add(batch.column("doc_id").slice(at, to - at), lengths[at:to] + 1, all_ids[base : int(ends[to - 1])])
                at, base = to, int(ends[to - 1])
        if writer.tokens:
            yield finished()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_order"))
    rows = rows.repartitionByRange("doc_id", "_order").sortWithinPartitions("doc_id", "_order").select("doc_id", "text")
    return written(rows.mapInArrow(write, FILES), "dac-files")


def placed(files: DataFrame) -> DataFrame:
    """The files with ``base``: ids of all files before each."""
    files = files.withColumn("group", F.floor(F.col("part") / GROUP))
    earlier = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("group").agg(F.sum("tokens").alias("sum")).select("group", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("group").orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    out = files.select("*", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("inside")).join(bases, "group")
    return out.select("path", (F.col("before") + F.col("inside")).alias("base"), "documents", "tokens")


def read_documents(files: DataFrame, folder: str, kind: str = "long", file_count: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the little-endian unsigned 32-bit ids), read from the files.

    ``kind``: the Spark type of document ids. A file is a task's unit of work; documents are decoded a million ids at a time, longer ones in parts.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source)
                    starts, keys = reader.starts(), reader.doc_ids().combine_chunks()
                    at = 0
                    while at < reader.documents:
                        to = max(at + 1, int(np.searchsorted(starts, starts[at] + READ_TOKENS, "right")) - 1)
                        crc = [0] * (to - at)
                        for low in range(int(starts[at]), int(starts[to]), READ_TOKENS):  # more than one round for a long document only
                            high = min(low + READ_TOKENS, int(starts[to]))
                            data = memoryview(reader.range(low, high).astype("<u4").tobytes())
                            for i in range(at, to):
                                a, b = max(int(starts[i]), low), min(int(starts[i + 1]), high)
                                crc[i - at] = zlib.crc32(data[4 * (a - low) : 4 * (b - low)], crc[i - at])
                        yield pa.RecordBatch.from_arrays(
                            [keys.slice(at, to - at), pa.array(starts[at:to] + base), pa.array(np.diff(starts[at : to + 1])), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        at = to

    found = placed(files).select("path", "base")
    return found.repartition(max(1, files.count() if file_count is None else file_count)).mapInArrow(
        read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def look_up(positions: DataFrame, files: DataFrame, folder: str, position: str = "position") -> DataFrame:
    """position, token: the id at each place of the whole sequence. Places outside it are left out, repeated ones stay repeated.

    Places meet files in buckets of the sequence (a file lies in at most a few), so that the join is on equal keys.
    """
    spans = placed(files).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("base") / BUCKET), F.floor((F.col("base") + F.col("tokens") - 1) / BUCKET))))
    wanted = positions.select(F.col(position).cast("long").alias("position")).withColumn("bucket", F.floor(F.col("position") / BUCKET))
    inside = (F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("tokens"))
    met = wanted.join(spans, "bucket").where(inside).select("path", "base", "position")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            paths = np.array(batch.column("path").to_pylist(), object)
            places, bases = batch.column("position").to_numpy(), batch.column("base").to_numpy()
            for name in np.unique(paths):
                mine = np.flatnonzero(paths == name)
                with system.open_input_file(f"{root}/{name}") as source:
                    found = Reader(source).at(places[mine] - bases[mine])
                yield pa.RecordBatch.from_arrays([pa.array(places[mine]), pa.array(found.astype(np.int64))], names=["position", "token"])

    return met.sortWithinPartitions("path", "position").mapInArrow(read, "position long, token long")


def dac_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "dac")
