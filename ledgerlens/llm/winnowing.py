"""Benchmark decontamination by winnowing.

Of the k-gram hashes of a text, every window of ``window - k + 1`` consecutive k-grams keeps its smallest. Two texts that share
``window`` consecutive words therefore keep a common hash, whatever surrounds it, so a join on the kept hashes finds every shared
span; each hit is then extended word by word to both sides and counts if it reaches ``window`` words. An item of fewer words than
``window`` is one span of its own length: documents are searched for it with all of their grams of that length.

Documents are read once, by tasks that pass on only the kept hashes that may occur in the benchmark (a bit table of fixed size,
so it cannot grow with the data; when it fills up more rows reach the join, no result changes). The join is on the hash, with a
row per occurrence; hash and neighbours of a row are all that the extension needs, so no text moves.

Defined cases: a null or wordless text has no words and no hits; a null item text never occurs; equal items all count; rows of the
documents are independent of each other, so repeated rows and ids give a row each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.words import LETTER_LOWER, Words, blocks, grams, lists, mix, words_of, written

WINDOW = 10
GRAM = 5
#: Size of the bit table that spares the join hashes that no item has.
FILTER_BITS = 1 << 22


def winnow(values: np.ndarray, at: np.ndarray, words: Words, window: int) -> np.ndarray:
    """Indexes into ``values`` of the smallest (the last of equals) of every ``window`` neighbours of one document.

    A document with fewer grams than ``window`` keeps its smallest.
    """
    if not len(values):
        return np.zeros(0, np.int64)
    document = words.document()[at]
    first = np.searchsorted(document, document)
    last = np.searchsorted(document, document, "right") - 1
    best = np.arange(len(values))
    index = np.arange(len(values))
    for step in range(1, window):
        other = np.minimum(index + step, last)
        best = np.where(values[other] <= values[best], np.maximum(other, best), best)
    return np.unique(best[(index + window - 1 <= last) | (index == first)])


def contexts(words: Words, at: np.ndarray, n: int, side: int, edge: int) -> np.ndarray:
    """Per gram its words and ``side`` words before and after it; ``edge`` where the document ends."""
    starts = np.repeat(words.offsets[:-1], np.diff(words.offsets))[at]
    ends = np.repeat(words.offsets[1:], np.diff(words.offsets))[at]
    place = at[:, None] + np.arange(-side, n + side)
    inside = (place >= starts[:, None]) & (place < ends[:, None])
    return np.where(inside, words.hashes[np.clip(place, 0, max(len(words.hashes) - 1, 0))], np.uint64(edge))


def kept_grams(words: Words, lengths: list[int], window: int, gram: int, short_items: bool) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, word positions, length): the winnowed grams, with length 0, and all grams of the short lengths.

    ``short_items``: a short length holds for texts of just that many words (the items' side).
    """
    size = np.diff(words.offsets)[words.document()] if len(words.hashes) else np.zeros(0, np.int64)
    found = []
    values, at = grams(words, gram)
    keep = winnow(values, at, words, window - gram + 1)
    if short_items:
        keep = keep[size[at[keep]] >= window]
    found.append((values[keep], at[keep], 0))
    for n in lengths:
        values, at = grams(words, n)
        if short_items:
            keep = size[at] == n
            values, at = values[keep], at[keep]
        found.append((mix(values ^ np.uint64(n)), at, n))
    return found


def item_grams(items: DataFrame, item_id: str, text: str, window: int, gram: int) -> DataFrame:
    """gram (hash), n (its words), context (hashes as bytes), items: ids of the items that have it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words = words_of(batch.column("text"), LETTER_LOWER)
            document = words.document()
            for values, at, n in kept_grams(words, list(range(1, window)), window, gram, True):
                around = contexts(words, at, n or gram, 0 if n else window - gram, 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("item_id").take(pa.array(document[at])), pa.array(values.view(np.int64)),
                    pa.array(np.full(len(at), n, np.int32)), pa.array([r.tobytes() for r in around], pa.binary())],
                    names=["item_id", "gram", "whole", "context"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    kind = dict(rows.dtypes)["item_id"]
    rows = rows.mapInArrow(scan, f"item_id {kind}, gram long, whole int, context binary")
    return rows.groupBy("gram", "whole", "context").agg(F.collect_set("item_id").alias("items"))


def document_grams(docs: DataFrame, doc_id: str, text: str, window: int, gram: int, lengths: list[int], allowed: np.ndarray) -> DataFrame:
    """A row per document: row (unique), doc_id, n_words, hits: its kept grams that pass the bit table."""
    side, bits = window - gram, np.uint64(FILTER_BITS - 1)
    shared = docs.sparkSession.sparkContext.broadcast(allowed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = shared.value
        for batch in blocks(batches, "text"):
            words = words_of(batch.column("text"), LETTER_LOWER)
            found = []
            for values, at, n in kept_grams(words, lengths, window, gram, False):
                slot = (values & bits).astype(np.int64)
                keep = np.flatnonzero(allowed[slot >> 3] & (1 << (slot & 7)).astype(np.uint8))
                around = contexts(words, at[keep], n or gram, 0 if n else side, 0)
                found.append((at[keep], values[keep], np.full(len(keep), n), [r.tobytes() for r in around]))
            at = np.concatenate([f[0] for f in found])
            order = np.argsort(at, kind="stable")
            document = words.document()
            offsets = np.searchsorted(at[order], words.offsets)
            context = [c for f in found for c in f[3]]
            hits = pa.StructArray.from_arrays([
                pa.array(np.concatenate([f[1] for f in found])[order].view(np.int64)),
                pa.array(np.concatenate([f[2] for f in found])[order].astype(np.int32)),
                pa.array((at[order] - words.offsets[document[at[order]]] if len(at) else at).astype(np.int32)),
                pa.array([context[i] for i in order], pa.binary())], names=["gram", "whole", "at", "context"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(words.offsets)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), hits)], names=["doc_id", "n_words", "hits"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    scanned = rows.mapInArrow(scan, f"doc_id {kind}, n_words long, hits array<struct<gram:long,whole:int,at:int,context:binary>>")
    return scanned.select(F.monotonically_increasing_id().alias("row"), "*")


def extended(pairs: DataFrame, window: int, gram: int) -> DataFrame:
    """row, items and the hit word span of each pair that reaches ``window`` words (or is a whole short item)."""
    side = window - gram

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch.column("whole").to_numpy()
            mine, theirs = batch.column("context").to_pylist(), batch.column("item_context").to_pylist()
            at = batch.column("at").to_numpy().astype(np.int64)
            start, end = at.copy(), at + whole
            good = np.array([a == b for a, b in zip(mine, theirs, strict=True)]) & (whole > 0)
            long = np.flatnonzero(whole == 0)
            if len(long):
                width = gram + 2 * side
                a = np.frombuffer(b"".join(mine[i] for i in long), np.uint64).reshape(-1, width)
                b = np.frombuffer(b"".join(theirs[i] for i in long), np.uint64).reshape(-1, width)
                same = a == b
                left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, side + gram :], axis=1).sum(axis=1)
                start[long], end[long] = at[long] - left, at[long] + gram + right
                good[long] = same[:, side : side + gram].all(axis=1) & (left + gram + right >= window)
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(keep), pa.array(start).take(keep), pa.array(end).take(keep), batch.column("items").take(keep)],
                names=["row", "start", "end", "items"])

    kind = dict(pairs.dtypes)["items"]
    return pairs.mapInArrow(extend, f"row long, start long, end long, items {kind}")


def find_contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """A row per document: doc_id, n_words, spans (merged word spans that occur in items), n_hit (words in them), items (sorted ids)."""
    assert 1 <= gram <= window
    known = written(item_grams(items, item_id, item_text, window, gram), "item-grams")
    lengths = sorted(r.whole for r in known.where("whole > 0").select("whole").distinct().collect())  # window - 1 values at most
    # Bits in use, at most FILTER_BITS / 8 numbers whatever the size of the benchmark.
    slot = F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1))
    used = known.select(F.shiftright(slot, 3).cast("int").alias("byte"), F.expr("shiftleft(1, cast(gram & 7 as int))").alias("bit"))
    used = used.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    allowed = np.zeros(FILTER_BITS >> 3, np.uint8)
    allowed[used["byte"].to_numpy(np.int64)] = used["bits"].to_numpy(np.int64).astype(np.uint8)

    rows = written(document_grams(docs, doc_id, text, window, gram, lengths, allowed), "document-grams")
    hits = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    pairs = hits.join(known.withColumnRenamed("context", "item_context"), ["gram", "whole"])
    found = extended(pairs, window, gram).groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("parts"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    merged = F.aggregate("parts", empty, lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1).getField("end") >= x["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1).getField("start").alias("start"), F.greatest(F.element_at(done, -1).getField("end"), x["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    found = found.select("row", F.coalesce(merged, empty).alias("spans"), F.array_sort("items").alias("items"))
    kind = dict(known.dtypes)["items"]
    return rows.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("spans", empty).alias("spans"),
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr(f"cast(array() as {kind})")).alias("items"))
