"""Near-duplicate groups by SuperMinHash, banding, verification on full sets, and union-find.

SuperMinHash gives every element of a set its own random permutation of the signature's places; place p of the signature is the
smallest "rank in the permutation plus a random fraction" of any element there. Ranks within one element are all different, which
lowers the variance against independent hashes, and once every place holds a rank below j no element needs its ranks from j on.
Here rank j is drawn for all elements of many documents at once, and documents whose places are filled leave the round.

Sets that are equal form a class at once; only classes are banded (32 bands of 5 places: a pair at the threshold shares no band in
3 of a million cases). Every class of a band bucket is compared with the smallest class there (a star, so a bucket of n classes
gives n - 1 pairs), then classes that this left in different components are compared in blocks, without writing pairs: bitmaps
bound the intersection from above, and only pairs within that bound are verified. Every link is confirmed on the full sets. Components come from large-star and small-star steps; nothing is collected.

Defined cases: null and wordless texts have no shingles and stay alone; equal ids of several rows give a row each; a null id never
is the smallest unless the group has no other. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.words import SPACE_LOWER, Words, blocks, grams, lists, mix, words_of, written
from ledgerlens.session import cut_lineage

BANDS, ROWS = 32, 5
#: Classes in a block of the second comparison, and elements that are ranked at once.
BLOCK, ELEMENTS = 256, 1 << 15
_GOLD, _FRACTION = np.uint64(0x9E3779B97F4A7C15), np.uint64(24)
FILTER_BITS = 1 << 20


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and their bounds.

    A text of fewer words than ``size`` has its whole sequence as its only shingle.
    """
    counts = np.diff(words.offsets)
    values, at = grams(words, size)
    per = np.maximum(counts - size + 1, 0)
    short = (counts > 0) & (counts < size)
    bounds = np.concatenate([[0], np.cumsum(per + short)])
    out = np.empty(bounds[-1], np.uint64)
    taken = np.zeros(len(out), bool)
    taken[bounds[:-1][short]] = True
    out[~taken] = values
    for i in np.flatnonzero(short):
        out[bounds[i]] = mix(np.array([sum(int(h) * 31**k for k, h in enumerate(words.hashes[words.offsets[i] : words.offsets[i + 1]])) % 2**64
                                       ^ int(counts[i])], np.uint64))[0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][bounds[:-1] < len(out)]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def signatures(elements: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """SuperMinHash signatures, a row per set: rank and fraction in one integer. Empty sets keep the largest value."""
    sets = len(bounds) - 1
    out = np.full(sets * places, np.iinfo(np.int64).max, np.int64)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    for at in range(0, len(elements), ELEMENTS):
        e, own = elements[at : at + ELEMENTS], owner[at : at + ELEMENTS]
        order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(e), 1))
        row = np.arange(len(e))
        for rank in range(places):
            draw = mix(e + np.uint64((rank + 1) * int(_GOLD) % 2**64))
            other = rank + (((draw & np.uint64(0xFFFFFF)) * np.uint64(places - rank)) >> _FRACTION).astype(np.int64)
            place = order[row, other].astype(np.int64)
            order[row, other] = order[:, rank]
            np.minimum.at(out, own * places + place, (np.int64(rank) << 40) | (draw >> _FRACTION).astype(np.int64))
            first, last = own[0], own[-1] + 1
            filled = out[first * places : last * places].reshape(-1, places).max(axis=1) < (np.int64(rank + 1) << 40)
            open_ = ~filled[own - first]
            if not open_.any():
                break
            if open_.mean() < 0.8:
                e, own, order = e[open_], own[open_], order[open_]
                row = np.arange(len(e))
    return out.reshape(sets, places)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.view(np.uint64).reshape(-1, bands, rows)
    out = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        out = mix(out * _GOLD + parts[:, :, r])
    return mix(out + np.arange(bands, dtype=np.uint64) * _GOLD)


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_keys(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify a set."""
    return tuple(mix(summed(mix(elements ^ np.uint64(c)), bounds)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit per hash value, of about eight bits per element and a power of two in size."""
    bits = 1 << max(9, int(8 * len(shingles) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(shingles.view(np.uint64) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A smaller bitmap of the same set: the leading bits of a hash choose its place, so neighbours fall together."""
    wide = np.unpackbits(bits).reshape(size * 8, -1).any(axis=1)
    return np.packbits(wide)


def sketch(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """A row per document: row, doc_id, n, k1, k2 (key of its set), bands."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            elements, bounds = shingle_sets(words_of(batch.column("text"), SPACE_LOWER), size)
            k1, k2 = set_keys(elements, bounds)
            hashes = band_hashes(signatures(elements, bounds, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                lists(hashes.reshape(-1).view(np.int64), np.arange(len(hashes) + 1) * bands, pa.int64())],
                names=["doc_id", "n", "k1", "k2", "bands"])

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.mapInArrow(scan, f"doc_id {kind}, n long, k1 long, k2 long, bands array<long>")
    return out.select(F.monotonically_increasing_id().alias("row"), "*")


def full_sets(docs: DataFrame, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """class and its shingles for the ``wanted`` classes (class, k1, k2): a second reading of the texts.

    Tasks pass on only sets that a bit table of fixed size lets through; the join decides.
    """
    used = wanted.select(F.expr(f"k1 & {FILTER_BITS - 1}").alias("slot"))
    used = used.select(F.expr("cast(shiftright(slot, 3) as int)").alias("byte"), F.expr("shiftleft(1, cast(slot & 7 as int))").alias("bit"))
    used = used.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most FILTER_BITS / 8 rows
    table = np.zeros(FILTER_BITS >> 3, np.uint8)
    table[used["byte"].to_numpy(np.int64)] = used["bits"].to_numpy(np.int64).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in blocks(batches, "text"):
            elements, bounds = shingle_sets(words_of(batch.column("text"), SPACE_LOWER), size)
            k1, k2 = set_keys(elements, bounds)
            slot = (k1 & np.uint64(FILTER_BITS - 1)).astype(np.int64)
            some = (np.diff(bounds) > 0) & ((table[slot >> 3] & (1 << (slot & 7)).astype(np.uint8)) > 0)
            _, one = np.unique(k1 ^ (k2 << np.uint64(1)), return_index=True)  # a copy in the same block needs no second row
            keep = np.intersect1d(np.flatnonzero(some), one)
            sizes = np.diff(bounds)[keep]
            values = np.concatenate([elements[bounds[i] : bounds[i + 1]] for i in keep]) if len(keep) else elements[:0]
            yield pa.RecordBatch.from_arrays([
                pa.array(k1[keep].view(np.int64)), pa.array(k2[keep].view(np.int64)),
                lists(values.view(np.int64), np.concatenate([[0], np.cumsum(sizes)]), pa.int64())], names=["k1", "k2", "shingles"])

    sets = docs.select(F.col(text).alias("text")).where("text is not null").mapInArrow(scan, "k1 long, k2 long, shingles array<long>")
    return sets.join(wanted.select("class", "k1", "k2"), ["k1", "k2"]).groupBy("class").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def roots(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for all nodes of the links (a, b)."""

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(lowest, "a")
        edges = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            lowest.select("a", F.col("m").alias("b"))).distinct()
        edges = cut_lineage(edges)
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def with_bitmaps(sets: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("shingles")
            yield pa.RecordBatch.from_arrays(
                [batch.column("class"), pa.array([bitmap(v.values.to_numpy()) for v in values], pa.binary())], names=["class", "bits"])

    return sets.mapInArrow(scan, "class long, bits binary")


def block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in the same bucket that sizes and bitmaps leave, compared block by block.

    members: bucket, class, comp, n, bits, bands. A pair is looked at in the first bucket that both are in. Classes outside a bucket's largest component meet all classes of the bucket, so a
    bucket that is one component already costs nothing. A bit set on one side only stands for at least one element that the
    other side lacks, which bounds the intersection from above.
    """
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most"))
    sizes = sizes.where("all > most").select(
        "bucket", "main", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("outer"))
    rows = members.join(sizes, "bucket")
    whole = rows.select(
        "*", F.lit(False).alias("out"), F.expr("pmod(xxhash64(class), blocks)").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)).alias("j"))
    out = rows.where("comp <> main").select(
        "*", F.lit(True).alias("out"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), F.expr("pmod(xxhash64(class, 1), outer)").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["out"]], group[~group["out"]]
        found = [np.zeros((0, 2), np.int64)]
        rn, rcomp, rid = right["n"].to_numpy(), right["comp"].to_numpy(), right["class"].to_numpy()
        bucket, rbands = group["bucket"].iloc[0], np.stack(list(right["bands"]))
        maps = [np.frombuffer(b, np.uint8) for b in right["bits"]]
        widths = np.array([len(m) for m in maps])
        for bits, bands, n, comp, own in zip(left["bits"], left["bands"], left["n"], left["comp"], left["class"], strict=True):
            mine = np.frombuffer(bits, np.uint8)
            near = np.flatnonzero((rcomp != comp) & (100 * np.minimum(rn, n) >= percent * np.maximum(rn, n)))
            near = near[rbands[near, (rbands[near] == bands).argmax(axis=1)] == bucket]
            for width in np.unique(widths[near]):
                some = near[widths[near] == width]
                low = min(width, len(mine))
                a = mine if len(mine) == low else fold(mine, low)
                b = np.stack([maps[i] if width == low else fold(maps[i], low) for i in some])
                most = np.minimum(n - np.bitwise_count(a & ~b).sum(axis=1), rn[some] - np.bitwise_count(b & ~a).sum(axis=1)).astype(np.int64)
                some = some[100 * most >= percent * (rn[some] + n - most)]
                found.append(np.stack([np.maximum(rid[some], own), np.minimum(rid[some], own)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    columns = ["bucket", "i", "j", "class", "comp", "n", "bits", "bands", "out"]
    return whole.select(columns).union(out.select(columns)).groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def placed(nodes: DataFrame, components: DataFrame, node: str, root: str) -> DataFrame:
    """``root``: the component of each ``node``, the node itself where it has no link."""
    known = components.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return nodes.join(known, node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest id reachable by links of at least ``percent``), kept."""
    rows_ = written(sketch(docs, doc_id, text, size, bands, rows), "sketches")
    classes = rows_.where("n > 0").groupBy("k1", "k2").agg(
        F.min("row").alias("class"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "shingle-classes")
    banded = classes.select("class", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min(F.struct("class", "n")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = written(banded.join(shared, "bucket").where(F.col("class") != F.col("leader.class")).select(
        "bucket", "class", "n", F.col("leader.class").alias("leader"), F.col("leader.n").alias("leader_n"), "size"), "bucket-members")

    near = 100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")
    star = members.where(near).select(F.col("class").alias("a"), F.col("leader").alias("b")).distinct()
    wanted = members.select("class").union(members.select("leader")).distinct().join(classes.select("class", "k1", "k2"), "class")
    sets = written(full_sets(docs, text, size, wanted), "shingle-sets")

    # One leader per class first: it settles most of a large group, so that few pairs are left to the next steps.
    known = roots(confirmed(star.groupBy("a").agg(F.min("b").alias("b")), sets, percent))
    apart = placed(placed(star, known, "a", "ra"), known, "b", "rb").where("ra <> rb").select("a", "b")
    edges = known.select(F.col("node").alias("a"), F.col("root").alias("b"))
    known = roots(edges.union(confirmed(apart, sets, percent)))

    rest = placed(members.where("size > 2").select("bucket", "class", "n"), known, "class", "comp")
    mixed = rest.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    rest = cut_lineage(rest.join(mixed, "bucket"))
    bits = with_bitmaps(sets.join(rest.select("class").distinct(), "class", "left_semi"))
    edges = known.select(F.col("node").alias("a"), F.col("root").alias("b"))
    known = roots(edges.union(confirmed(block_pairs(rest.join(bits, "class").join(classes.select("class", "bands"), "class"), percent), sets, percent)))

    found = placed(classes.select("k1", "k2", "class", "first_id"), known, "class", "root")
    smallest = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = found.join(smallest, "root").select("k1", "k2", "component_id")
    out = rows_.select("doc_id", "n", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
