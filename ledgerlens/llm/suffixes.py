"""Repeated passages by a sparse suffix array over words.

Suffixes are kept only at minimiser positions: of every ``WINDOWS`` consecutive k-grams the smallest hash is chosen, by content, so two texts that
share ``least`` words have a chosen position in common in the first ``WINDOWS`` words of the share, with at least ``least - WINDOWS + 1`` shared words
from it on (the head). Suffixes whose head stands in one document only cannot be part of such a share and are dropped after a count; tasks
skip most of them in the second reading already, by a bit table of fixed size. The rest are sorted twice: by head and following words, and by head
and preceding words (nearest first). In each order a suffix's longest match with another document is with a neighbour, so comparing neighbours
extends the head to the right and to the left as far as any other document allows, up to the next chosen positions, whose own matches go on.

Sorting is by range over head, words and document together, so a head that a third of all documents share is cut into many
partitions; what neighbours across partitions share is found from the rows at the edges. Overlapping matches of a document are merged; as they may be
with different documents, all windows of ``least`` words inside the merged stretches are hashed; what is left of the stretches without the windows
that one document has only is the result.

Defined cases: null and short texts have no repeats; rows of equal id are one document and don't repeat each other, nor does a document repeat
itself; a null id is an id. Spans belong to a text: an id with several texts has the spans of each, told apart by the hash of the text, and rows
of equal id and text give them once. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.winnowing import winnow
from ledgerlens.llm.words import SPACE_LOWER, Words, blocks, grams, mix, words_of, written

LEAST, WINDOWS, GRAM = 50, 24, 8
FILTER_BITS = 1 << 24
NONE = np.uint32(0)


def suffix_places(words: Words, least: int, windows: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the heads and word positions of the chosen suffixes that have a whole head."""
    head = least - windows + 1
    values, at = grams(words, gram)
    chosen = at[winnow(values, at, words, windows)]
    heads, where = grams(words, head)
    keep = np.searchsorted(where, chosen)
    keep = keep[(keep < len(where)) & (where[np.minimum(keep, max(len(where) - 1, 0))] == chosen)] if len(where) else np.zeros(0, np.int64)
    return heads[keep], where[keep]


def sides(words: Words, at: np.ndarray, first: int, step: int, count: int) -> np.ndarray:
    """32-bit hashes of ``count`` words from ``at + first`` on in steps of ``step``, 0 outside the document; big-endian, so bytes sort alike."""
    starts = np.repeat(words.offsets[:-1], np.diff(words.offsets))[at]
    ends = np.repeat(words.offsets[1:], np.diff(words.offsets))[at]
    place = at[:, None] + first + step * np.arange(count)
    inside = (place >= starts[:, None]) & (place < ends[:, None])
    low = (words.hashes[np.clip(place, 0, len(words.hashes) - 1)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.where(inside, low, NONE).astype(">u4")


def heads_of(docs: DataFrame, least: int, windows: int, gram: int) -> DataFrame:
    """head of suffixes that two documents have."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words = words_of(batch.column("text"), SPACE_LOWER)
            heads, at = suffix_places(words, least, windows, gram)
            key = batch.column("key").to_numpy()[words.document()[at]]
            # A document's equal heads count once.
            order = np.lexsort((heads, key))
            new = np.ones(len(order), bool)
            new[1:] = (heads[order][1:] != heads[order][:-1]) | (key[order][1:] != key[order][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(heads[order][new].view(np.int64)), pa.array(key[order][new])], names=["head", "key"])

    found = docs.mapInArrow(scan, "head long, key long").groupBy("head").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    return found.where("low <> high").select("head")


def bit_table(values: DataFrame, name: str) -> np.ndarray:
    """A table of fixed size with a bit for the low bits of each value: what has none is not among the values."""
    used = values.select(F.expr(f"{name} & {FILTER_BITS - 1}").alias("slot"))
    used = used.select(F.expr("cast(shiftright(slot, 3) as int)").alias("byte"), F.expr("shiftleft(1, cast(slot & 7 as int))").alias("bit"))
    used = used.groupBy("byte").agg(F.bit_or("bit").cast("smallint").alias("bits")).toArrow()  # at most FILTER_BITS / 8 rows of six bytes
    table = np.zeros(FILTER_BITS >> 3, np.uint8)
    table[used["byte"].to_numpy()] = used["bits"].to_numpy().astype(np.uint8)
    return table


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = (values & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (table[slot >> 3] & (1 << (slot & 7)).astype(np.uint8)) > 0


def suffixes(docs: DataFrame, heads: DataFrame, least: int, windows: int, gram: int) -> DataFrame:
    """key, row, head, right and left (neighbouring words), places (word positions): a row for equal suffixes of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(heads, "head"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in blocks(batches, "text"):
            words = words_of(batch.column("text"), SPACE_LOWER)
            found, at = suffix_places(words, least, windows, gram)
            keep = in_table(table, found)
            found, at = found[keep], at[keep]
            document = words.document()[at] if len(at) else at
            right = sides(words, at, least - windows + 1, 1, windows) if len(at) else np.zeros((0, windows), ">u4")
            left = sides(words, at, -1, -1, windows - 1) if len(at) else np.zeros((0, windows - 1), ">u4")
            # Equal suffixes of a document (a repeated line, say) are one row with several places.
            same = found.copy()
            for c in np.concatenate([right, left], axis=1).astype(np.uint64).T:
                same = mix(same * np.uint64(31) + c)
            same = mix(same + document.astype(np.uint64))
            order = np.argsort(same, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]])) if len(order) else order
            head = order[first]
            places = (at - words.offsets[document])[order] if len(order) else at
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(pa.array(document[head])) for c in ("key", "row")], pa.array(found[head].view(np.int64)),
                pa.array([r.tobytes() for r in right[head]], pa.binary()), pa.array([r.tobytes() for r in left[head]], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(places.astype(np.int32)))],
                names=["key", "row", "head", "right", "left", "places"])

    return docs.mapInArrow(scan, "key long, row long, head long, right binary, left binary, places array<int>").join(heads, "head", "left_semi")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading words that rows share; a document's end matches nothing."""
    return np.cumprod((a == b) & (a != NONE), axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)


def best_matches(head: np.ndarray, key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of each row of a sorted run the longest match with another document, -1 for none.

    Matches only shrink with distance, so the nearest row of another document on either side decides.
    """
    n = len(head)
    after, before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return after
    step = np.where(head[1:] == head[:-1], common(words[1:], words[:-1]), -1)
    after[:-1] = before[1:] = step
    # Where the next row is of the same document, its own match decides, limited by the step to it.
    own = np.flatnonzero(key[1:] == key[:-1])
    for i in own[::-1]:
        after[i] = min(step[i], after[i + 1])
    for i in own:
        before[i + 1] = min(step[i], before[i])
    return np.maximum(after, before)


def neighbours(rows: DataFrame, side: str, width: int) -> DataFrame:
    """key, row, places, more: by how many words a suffix's best match goes on beyond its head, on one side."""
    ordered = rows.select("key", "row", "head", F.col(side).alias("words"), "places").repartitionByRange("head", "words", "key").sortWithinPartitions("head", "words", "key")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their best match inside the partition; only rows at the partition's edges keep their words, to be compared across."""
        part = TaskContext.get().partitionId()

        def out(batch: pa.Table, best: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            n = len(best)
            return pa.RecordBatch.from_arrays([
                batch["key"].combine_chunks(), batch["row"].combine_chunks(), batch["head"].combine_chunks(), pa.array(np.full(n, part, np.int32)), pa.array(best),
                pa.array(edge), pc.if_else(pa.array(edge), batch["words"].combine_chunks(), pa.scalar(None, pa.binary())), batch["places"].combine_chunks()],
                names=["key", "row", "head", "part", "more", "edge", "words", "places"])

        tail, tail_best, first = None, np.zeros(0, np.int64), True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if tail is None else pa.concat_tables([tail, table])
            head, key = table["head"].to_numpy(), table["key"].to_numpy()
            words = np.frombuffer(b"".join(table["words"].to_pylist()), ">u4").reshape(-1, width)
            best = best_matches(head, key, words)
            best[: len(tail_best)] = np.maximum(best[: len(tail_best)], tail_best)
            # The last document's rows wait for what follows, with one row of another document before them.
            last = len(key) - 1
            while last > 0 and key[last - 1] == key[-1] and head[last - 1] == head[-1]:
                last -= 1
            cut = max(last - 1, 0)
            if cut:
                edge = np.zeros(cut, bool)
                if first:
                    edge[: lead(head, key)] = True
                    first = False
                yield out(table.slice(0, cut), best[:cut], edge)
            tail, tail_best = table.slice(cut), best[cut:]
        if tail is not None:
            yield out(tail, tail_best, np.ones(len(tail_best), bool))

    kind = "key long, row long, head long, part int, more long, edge boolean, words binary, places array<int>"
    found = written(ordered.mapInArrow(runs, kind), f"suffix-{side}")
    # A partition's edge is the rows of its first and last document and one row further: few rows for each partition.
    edges = found.where("edge").orderBy("part", "head", "words", "key").coalesce(1)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        words = np.frombuffer(b"".join(table["words"].to_pylist()), ">u4").reshape(-1, width)
        best = best_matches(table["head"].to_numpy(), table["key"].to_numpy(), words)
        best = np.maximum(best, table["more"].to_numpy())
        yield pa.RecordBatch.from_arrays(
            [table["key"].combine_chunks(), table["row"].combine_chunks(), pa.array(best), table["places"].combine_chunks()], names=["key", "row", "more", "places"])

    crossed = edges.mapInArrow(across, "key long, row long, more long, places array<int>")
    return found.where("not edge").select("key", "row", "more", "places").union(crossed).where("more >= 0")


def lead(head: np.ndarray, key: np.ndarray) -> int:
    """Rows of the first document in the first head, and one more."""
    n = 1
    while n < len(key) and key[n] == key[0] and head[n] == head[0]:
        n += 1
    return min(n + 1, len(key))


def joined(spans: DataFrame) -> DataFrame:
    """key, row, start, end: the union of each text's spans."""
    # A text's spans in order: a new stretch begins where no earlier span reaches.
    earlier = Window.partitionBy("key", "row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("new", (F.coalesce(F.max("end").over(earlier), F.lit(-1)) < F.col("start")).cast("int"))
    spans = spans.withColumn("stretch", F.sum("new").over(Window.partitionBy("key", "row").orderBy("start")))
    return spans.groupBy("key", "row", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("key", "row", "start", "end")


def windows_inside(rows: DataFrame, stretches: DataFrame, least: int) -> DataFrame:
    """key, row, stretch (its start), start and hash of each window of ``least`` words within a stretch of its text."""
    listed = stretches.groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    listed = listed.select("key", "row", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            words = words_of(batch.column("text"), SPACE_LOWER)
            hashes, at = grams(words, least)
            counts = batch.column("starts").value_lengths().to_numpy(zero_copy_only=False)
            first = np.repeat(words.offsets[:-1], counts)
            starts = first + batch.column("starts").flatten().to_numpy()
            ends = first + batch.column("ends").flatten().to_numpy()
            of = np.searchsorted(starts, at, "right") - 1
            keep = (of >= 0) & (at + least <= ends[of]) if len(ends) else np.zeros(len(at), bool)
            document = words.document()[at[keep]]
            begin = words.offsets[document]
            stretch = starts[of[keep]] - begin if len(ends) else begin
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(document)) for c in ("key", "row")], pa.array(stretch.astype(np.int32)),
                 pa.array((at[keep] - begin).astype(np.int32)), pa.array(hashes[keep].view(np.int64))],
                names=["key", "row", "stretch", "start", "hash"])

    there = rows.join(listed, ["key", "row"]).select("key", "row", "text", "starts", "ends")
    return there.mapInArrow(scan, "key long, row long, stretch int, start int, hash long")


def lone_windows(inside: DataFrame) -> DataFrame:
    """key, row, stretch, start of the windows that one document has only.

    Nearly all windows of a stretch are shared, and most of these are told by a bit table of the lone hashes, so few rows move.
    """
    lone = inside.groupBy("hash").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low = high").select("hash")
    lone = written(lone, "suffix-lone")
    table = inside.sparkSession.sparkContext.broadcast(bit_table(lone, "hash"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_table(table.value, batch.column("hash").to_numpy().view(np.uint64))))

    doubtful = inside.mapInArrow(scan, "key long, row long, stretch int, start int, hash long")
    return doubtful.join(lone, "hash", "left_semi").select("key", "row", "stretch", "start").distinct()


def without(stretches: DataFrame, lone: DataFrame, least: int) -> DataFrame:
    """key, row, start, end: the runs of windows of each stretch that its lone windows leave."""
    border = stretches.select("key", "row", F.col("start").alias("stretch"), (F.col("start") - 1).alias("at"), (F.col("end") - least + 1).alias("last"))
    inner = lone.select("key", "row", F.col("stretch").cast("long").alias("stretch"), F.col("start").cast("long").alias("at"), F.lit(None).cast("long").alias("last"))
    whole = Window.partitionBy("key", "row", "stretch")
    runs = border.union(inner).select(
        "key", "row", (F.col("at") + 1).alias("start"), F.coalesce(F.lead("at").over(whole.orderBy("at")), F.max("last").over(whole)).alias("stop"))
    return runs.where("start < stop").select("key", "row", "start", (F.col("stop") - 1 + least).alias("end"))


def repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, windows: int = WINDOWS, gram: int = GRAM,
) -> DataFrame:
    """doc_id, text_hash, start, end (words): the stretches of each text that other documents have, too."""
    head = least - windows + 1
    assert gram <= head
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    whole = dict(ids.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) if whole else F.xxhash64("doc_id")
    ids = ids.withColumn("key", key)
    rows = ids.where("text is not null").select("key", F.xxhash64("text").alias("row"), "text")
    heads = written(heads_of(rows, least, windows, gram), "suffix-heads")
    kept = written(suffixes(rows, heads, least, windows, gram), "suffixes")
    right = neighbours(kept, "right", windows).select("key", "row", F.explode("places").alias("start"), (F.col("more") + head).alias("length"), F.lit(0).alias("before"))
    left = neighbours(kept, "left", windows - 1).select("key", "row", F.explode("places").alias("start"), F.lit(head).cast("long").alias("length"), F.col("more").alias("before"))
    spans = right.union(left.select("key", "row", "start", "length", "before")).select(
        "key", "row", (F.col("start") - F.col("before")).cast("long").alias("start"), (F.col("start") + F.col("length")).alias("end"))
    spans = spans.groupBy("key", "row", "start").agg(F.max("end").alias("end"))
    long = written(joined(spans).where(F.col("end") - F.col("start") >= least), "suffix-stretches")
    inside = written(windows_inside(rows, long, least), "suffix-windows")
    merged = joined(without(long, lone_windows(inside), least))
    return merged.join(ids.select("doc_id", "key").distinct(), "key").select("doc_id", F.col("row").alias("text_hash"), "start", "end")
