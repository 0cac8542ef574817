"""Ranked lexical search over classes of equal bags of words.

All documents are ranked for each item of a query set. What a document scores depends on the counts of the items' terms in it and on its length
penalty m alone, so documents are restricted to the vocabulary of the items, and those of the same term counts and the same m form a class:
found by a hash, verified by the counts themselves. A class is scored once; its members follow in ascending order of their ids, of which
the best k per class are enough for the best k per item.

Terms are the runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered. With N documents that have a term, L terms in all, n
terms of a document, df documents with a term and tf of it in one, a term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), m is
25 + (75 n N div L), and a document scores the sum of w (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included.

The items are taken in blocks of about ``BLOCK_TERMS`` item terms, so what a task holds of them is bounded; each block is one pass over the
documents. A task keeps the best k classes per item of what it reads. Terms are compared as 64-bit hashes with their lengths.

Defined cases: null texts and texts without a term are in no result and not in N; an item without a known term has no rows; rows that repeat an item
get a list each; equal scores rank by ascending document id, a null id last; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.words import LETTER_LOWER, blocks, lists, mix, words_of, written
from ledgerlens.skew import top_per_key

#: Distinct terms of the items of a block, added up; scores that a task holds at once.
BLOCK_TERMS, CELLS = 1 << 18, 1 << 20
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number of 64 bits per term, made of its hash and length, and the texts' bounds."""
    words = words_of(column, LETTER_LOWER)
    return mix(words.hashes ^ ((words.ends - words.starts).astype(np.uint64) * _LENGTH)), words.offsets


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (row number), item_id, terms and their repeats; items without a term are left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            terms, bounds = terms_of(batch.column("text"))
            found = [np.unique(terms[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in found])])
            yield pa.RecordBatch.from_arrays([
                batch.column("item"), batch.column("item_id"), lists(np.concatenate([t for t, _ in found]).view(np.int64), offsets, pa.int64()),
                lists(np.concatenate([c for _, c in found]), offsets, pa.int64())], names=["item", "item_id", "terms", "repeats"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"item long, item_id {kind}, terms array<long>, repeats array<long>").where("size(terms) > 0")


def restricted(docs: DataFrame, vocabulary: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (all terms), bag: places in the sorted vocabulary and counts, as pairs of unsigned 32-bit numbers; empty if there are none."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in blocks(batches, "text"):
            terms, bounds = terms_of(batch.column("text"))
            place = np.searchsorted(vocabulary, terms)
            place[place == len(vocabulary)] = 0
            here = np.flatnonzero(vocabulary[place] == terms)
            owner = np.searchsorted(bounds, here, "right") - 1
            found, counts = np.unique(owner * len(vocabulary) + place[here], return_counts=True)
            pairs = np.empty((len(found), 2), "<u4")
            pairs[:, 0], pairs[:, 1] = found % len(vocabulary), counts
            ends = np.searchsorted(found, np.arange(batch.num_rows + 1) * len(vocabulary)) * 8
            bags = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pairs.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), bags.cast(pa.binary())], names=["doc_id", "n", "bag"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, bag binary")


def bag_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of bags: the bag, place and count of each pair."""
    column = column.cast(pa.large_binary())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    pairs = np.frombuffer(data, "<u4")[bounds[0] // 4 : bounds[-1] // 4].reshape(-1, 2) if data is not None else np.zeros((0, 2), "<u4")
    return np.repeat(np.arange(len(column)), np.diff(bounds) // 8), pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def document_counts(classes: DataFrame, terms: int) -> DataFrame:
    """place, df: the documents with each term, counted by classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            bag, place, _ = bag_arrays(batch.column("bag"))
            np.add.at(df, place, batch.column("size").to_numpy()[bag])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["place", "df"])

    return classes.select("bag", "size").mapInArrow(count, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))


def best_classes(classes: DataFrame, weights: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], items: int, k: int) -> DataFrame:
    """slot (of the item), score, key, m, first_id: the best k classes per item in each task, by score, then smallest id.

    classes: key, m, bag, first_id. postings: for each term of the vocabulary where its items begin, their slots, their repeats.
    """
    shared = classes.sparkSession.sparkContext.broadcast((weights, *postings))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, begins, slots, repeats = shared.value
        # Sums of doubles are exact while they stay below 2**53.
        most = int(weights.max(initial=0)) * 1_000_000 * int(np.bincount(slots, repeats).max(initial=0))
        # Rows come in order of their smallest id, so a stable sort of the scores breaks ties by it; the best so far stand first.
        best, held = np.zeros((0, items), np.int64), np.zeros((0, items), np.int64)
        kept: list[tuple[int, pa.RecordBatch]] = []
        rows_before = 0
        for batch in batches:
            size = max(1, CELLS // items)
            for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                bag, place, tf = bag_arrays(part.column("bag"))
                m = part.column("m").to_numpy()[bag]
                value = weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                lengths = begins[place + 1] - begins[place]
                at = np.repeat(begins[place] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
                cell, value = np.repeat(bag, lengths) * items + slots[at], np.repeat(value, lengths) * repeats[at]
                if most < 1 << 53:
                    scores = np.bincount(cell, value, part.num_rows * items).astype(np.int64)
                else:
                    scores = np.zeros(part.num_rows * items, np.int64)
                    np.add.at(scores, cell, value)
                all_scores = np.concatenate([best, scores.reshape(-1, items)])
                numbers = np.concatenate([held, np.repeat(np.arange(rows_before, rows_before + part.num_rows)[:, None], items, axis=1)])
                order = np.argsort(-all_scores, axis=0, kind="stable")[:k]
                best, held = np.take_along_axis(all_scores, order, 0), np.take_along_axis(numbers, order, 0)
                kept.append((rows_before, part.select(["key", "m", "first_id"])))
                rows_before += part.num_rows
            used = np.unique(held[best > 0])  # only batches with a class that is still among the best stay in memory
            kept = [(n, p) for n, p in kept if np.searchsorted(used, n) < np.searchsorted(used, n + p.num_rows)]
        row, slot = np.nonzero(best > 0)
        number, value = held[row, slot], best[row, slot]
        for n, part in kept:
            mine = np.flatnonzero((number >= n) & (number < n + part.num_rows))
            if len(mine):
                taken = part.take(pa.array(number[mine] - n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot[mine]), pa.array(value[mine]), *taken.columns], names=["slot", "score", "key", "m", "first_id"])

    kind = classes.schema["first_id"].dataType.simpleString()
    key = classes.schema["key"].dataType.simpleString()
    rows = classes.select("key", "m", "bag", "first_id").sortWithinPartitions(F.col("first_id").asc_nulls_last())
    return rows.mapInArrow(score, f"slot long, score long, key {key}, m long, first_id {kind}")


def rank_block(docs: DataFrame, items: DataFrame, doc_id: str, text: str, k: int) -> DataFrame | None:
    """The best k documents of the items (item, item_id, terms, repeats) of one block; None if no document has a term."""
    spark = docs.sparkSession
    listed = items.select("item", F.explode(F.arrays_zip("terms", "repeats")).alias("t")).select("item", "t.terms", "t.repeats").toPandas()
    vocabulary, place = np.unique(listed["terms"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    names, slot = np.unique(listed["item"].to_numpy(np.int64), return_inverse=True)
    order = np.argsort(place, kind="stable")
    begins = np.searchsorted(place[order], np.arange(len(vocabulary) + 1))

    bags = written(restricted(docs, vocabulary, doc_id, text), "bags")
    total = bags.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    if not total["documents"]:
        return None
    whole = "cast({} as decimal({}, 0))"
    m = F.expr(f"25 + (75 * {whole.format('n', 12)} * {whole.format(total['documents'], 19)}) div {whole.format(total['terms'], 19)}")
    hashed = bags.where("length(bag) > 0").select("doc_id", m.alias("m"), F.xxhash64("bag").alias("hash"), "bag")
    classes = written(hashed.groupBy("hash", "m", "bag").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_id")), "bag-classes")
    apart = classes.groupBy("hash", "m").agg(F.count("*").alias("bags")).where("bags > 1").limit(1).count()
    # Different bags of one hash (about never): the bag itself is the key then.
    key = F.col("bag") if apart else F.col("hash")

    df = np.zeros(len(vocabulary), np.int64)
    for row in document_counts(classes, len(vocabulary)).collect():  # at most the block's terms
        df[row["place"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    best = best_classes(
        classes.withColumn("key", key), weights, (begins, slot[order], listed["repeats"].to_numpy(np.int64)[order]), len(names), k)
    best = written(top_per_key(best, ["slot"], [F.desc("score"), F.col("first_id").asc_nulls_last()], k, "_class"), "best-classes")

    # A class gives its first k documents at most; none of its later ones can be among an item's best k.
    members = top_per_key(hashed.select("doc_id", "m", key.alias("key")), ["key", "m"], [F.col("doc_id").asc_nulls_last()], k, "_member")
    found = best.select("slot", "score", "key", "m").join(members, ["key", "m"])
    found = top_per_key(found.select("slot", "score", "doc_id"), ["slot"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k)
    slots = spark.createDataFrame([(i, int(n)) for i, n in enumerate(names)], "slot long, item long")
    return found.join(slots, "slot").join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score above 0 for each item."""
    listed = written(item_terms(items, item_id, item_text), "item-terms")
    terms = listed.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = max(1, -(-terms // block_terms))
    found = []
    for part in range(parts if terms else 0):
        block = listed.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else listed
        found.append(rank_block(docs, block, doc_id, text, k))
    found = [f for f in found if f is not None]
    if not found:
        kinds = [d.schema[c].dataType.simpleString() for d, c in ((items, item_id), (docs, doc_id))]
        return docs.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    return reduce(DataFrame.union, found)
