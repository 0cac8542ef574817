"""Documents of flat token files by a scan for separators.

A flat file holds nothing but token ids; where its documents lie is found by looking for the end-of-document id. Files are cut into
blocks that are read and searched independently (one vectorised comparison each). A block knows its own separators only: how many
documents end before it, and where its first document starts, come from a prefix scan over the blocks' counts and last
separators. The scan has two levels, sums of a thousand blocks first, so one large file does not meet in a task.

Defined cases: a marker of the vocabulary inside a text is written as the ids of its letters, never as the separator; ids that ``width`` bytes
can't hold are refused; an empty file has no documents; separators in a row end empty documents; tokens after the last separator are a document that is not
terminated; bytes after the last whole token are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tokens import WordIds
from ledgerlens.llm.words import blocks, text_bytes, written
from ledgerlens.session import scratch_path

_PLAIN: dict[str, PlainIds] = {}


class PlainIds(WordIds):
    """Ids of texts whose markers are letters like any other."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True

    @classmethod
    def of(cls, path: str) -> PlainIds:
        """The worker's own instance."""
        if path not in _PLAIN:
            _PLAIN[path] = cls(path)
        return _PLAIN[path]


#: Bytes of a block; blocks of a group of the prefix scan.
BLOCK, GROUP = 4 << 20, 1024


def file_system(path: str):
    """The file system of a path and the path in it, for tasks."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, separator: int, doc_id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Writes a flat file of little-endian ids of ``width`` bytes for each partition: the ids of each text, then the separator.

    Returns file, documents, tokens. A file appears under its name when it is complete, so a repeated task does no harm.
    """
    kind = {2: "<u2", 4: "<u4"}[width]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        words, end = WordIds.of(tokenizer), np.array([separator], kind).tobytes()
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        part = f"{root}/_{name}-{uuid.uuid4().hex}"
        system.create_dir(root, recursive=True)
        documents = tokens = 0
        with system.open_output_stream(part) as out:
            for batch in blocks(batches, "text"):
                data, bounds = text_bytes(batch.column("text"))
                texts = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                for one, ids in zip(texts, words.encode_all(texts), strict=True):
                    ids = np.frombuffer(ids, "<u4")
                    if (ids == separator).any():
                        ids = np.frombuffer(PlainIds.of(tokenizer).encode(one), "<u4")
                    if (ids == separator).any() or (ids >> np.uint32(8 * width - 1) > 1).any():
                        raise ValueError(f"a text has the separator {separator}, or an id above {width} bytes, among its ids")
                    out.write(ids.astype(kind).tobytes() + end)
                    documents, tokens = documents + 1, tokens + len(ids) + 1
        system.move(part, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([documents]), pa.array([tokens])], names=["file", "documents", "tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(write, "file string, documents long, tokens long")


def find_documents(spark: SparkSession, folder: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, doc_no, start, length (tokens without the separator), terminated: the documents of all token files in a folder."""
    assert block % width == 0
    kind = {2: "<u2", 4: "<u4"}[width]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    count = F.ceil(F.col("length") / block)
    parts = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, no in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, inner = file_system(path)
                with system.open_input_file(inner) as source:
                    data = source.read_at(min(block, length - no * block), no * block)
                ids = np.frombuffer(data, kind, len(data) // width)
                found = np.flatnonzero(ids == separator) + no * (block // width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path]), pa.array([no]), pa.array([no * (block // width) + len(ids)]), pa.array([len(found)]),
                    pa.array([int(found[-1]) if len(found) else None], pa.int64()), pa.array([found], pa.list_(pa.int64()))],
                    names=["path", "block", "end", "n", "last", "found"])

    # A block is one row of work: they are dealt out evenly, whatever file they are from.
    seen = parts.repartition("path", "block").mapInArrow(search, "path string, block long, end long, n long, last long, found array<long>")
    seen = written(seen, "separators").withColumn("group", F.floor(F.col("block") / GROUP))
    groups = seen.groupBy("path", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("end").alias("end"))
    earlier = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select(
        "path", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("before"))
    inside = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.select(
        "path", "group", "found", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n_before"), F.max("last").over(inside).alias("last_before"))
    placed = placed.join(bases, ["path", "group"])
    previous = F.coalesce("last_before", "before")
    ends = placed.select("path", (F.col("base") + F.col("n_before")).alias("first"), previous.alias("previous"), "found", F.posexplode("found").alias("i", "at"))
    ended = ends.select(
        "path", (F.col("first") + F.col("i")).alias("doc_no"), (F.when(F.col("i") == 0, F.col("previous")).otherwise(F.get("found", F.col("i") - 1)) + 1).alias("start"), "at",
        F.lit(True).alias("terminated"))
    open_ = groups.groupBy("path").agg(F.sum("n").alias("doc_no"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("end").alias("at"))
    open_ = open_.where("at > start").select("path", "doc_no", "start", "at", F.lit(False).alias("terminated"))
    return ended.union(open_).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "doc_no", "start", (F.col("at") - F.col("start")).alias("length"), "terminated")


def token_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "token-files")
