"""Merkle fixity audit of WARC replicas.

Every record has a SHA-256 hash. The leaves of a file's tree are its ordered byte ranges of fixed length (the records that start in one);
a node's hash covers its children's numbers and hashes in order, up to one root per file. An audit compares roots, and goes down only where
hashes differ: at each level the children of differing nodes are compared, and only records of differing ranges are looked at one by one. Levels are
the logarithm of a file's size, so the loop over them is short; payloads are read once, for their hashes.

Defined cases: records without a file or offset take part with those values as keys; a null payload hashes like an empty one but keeps a null length;
records of equal file and offset are told apart by number in the order of their hashes; records that stand elsewhere in the same file of the other
replica, as all do that follow a lost one, are moved, equal ones paired in order; a file that only one replica has differs in all of its records.
Equal replicas give no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.words import written

RANGE, FAN = 1 << 16, 16
NULL_FILE, NULL_OFFSET = "", -1


def index(records: DataFrame, file: str = "file", offset: str = "offset", payload: str = "payload", span: int = RANGE) -> DataFrame:
    """file, offset, copy (number among equal offsets), range, length, sha256 of each record."""
    rows = records.select(
        F.coalesce(F.col(file).cast("string"), F.lit(NULL_FILE)).alias("file"), F.coalesce(F.col(offset).cast("long"), F.lit(NULL_OFFSET)).alias("offset"),
        F.octet_length(payload).cast("long").alias("length"), F.sha2(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), 256).alias("sha256"))
    same = Window.partitionBy("file", "offset").orderBy("sha256", "length")
    return rows.select("file", "offset", F.row_number().over(same).alias("copy"), F.floor(F.col("offset") / span).alias("range"), "length", "sha256")


def node(parts: Column) -> Column:
    """Hash of ordered parts."""
    return F.sha2(F.array_join(parts, "\n"), 256)


def tree(records: DataFrame, levels: int, fan: int = FAN) -> DataFrame:
    """level, file, no, hash: leaves at level 0, one root per file at level ``levels``. A node gathers a range or ``fan`` nodes."""
    part = F.struct("offset", "copy", "length", "sha256")
    text = lambda s: F.concat_ws(":", s["offset"], s["copy"], s["length"], s["sha256"])
    level = records.groupBy("file", F.col("range").alias("no")).agg(node(F.transform(F.array_sort(F.collect_list(part)), text)).alias("hash"))
    level = written(level, "merkle-0")
    out = level.select(F.lit(0).alias("level"), "file", "no", "hash")
    for k in range(1, levels + 1):
        pair = F.struct("no", "hash")
        level = level.groupBy("file", F.floor(F.col("no") / fan).alias("parent")).agg(
            node(F.transform(F.array_sort(F.collect_list(pair)), lambda s: F.concat_ws(":", s["no"], s["hash"]))).alias("hash"))
        level = written(level.withColumnRenamed("parent", "no"), f"merkle-{k}")
        out = out.union(level.select(F.lit(k).alias("level"), "file", "no", "hash"))
    return out


def audit(left: DataFrame, right: DataFrame, fan: int = FAN) -> DataFrame:
    """Differing records of two indexes: file, offset, copy, status, left and right length and sha256, right_offset.

    ``changed``: other content at the same offset; ``missing``: only the left replica has the record; ``extra``: only the right one;
    ``moved``: the right replica has it at ``right_offset``. A record that was changed behind a lost one is missing and extra.
    """
    left, right = written(left, "replica-left"), written(right, "replica-right")
    # Ranges are numbered from -1 (no offset) up, so a tree is complete when the highest number's path ends at 0 and -1 stays apart.
    top = max(r[0] or 0 for r in (left.agg(F.max("range")).first(), right.agg(F.max("range")).first()))
    levels = 0
    while fan**levels <= top:
        levels += 1
    trees = [tree(side, levels, fan) for side in (left, right)]
    bad = None
    for k in range(levels, -1, -1):
        a, b = (t.where(F.col("level") == k).select("file", "no", F.col("hash").alias(h)) for t, h in zip(trees, ("a", "b"), strict=True))
        if bad is not None:
            parent = bad.select(F.col("file").alias("_file"), F.col("no").alias("_no"))
            child = lambda side: side.join(parent, (F.col("file") == F.col("_file")) & (F.floor(F.col("no") / fan) == F.col("_no")), "left_semi")
            a, b = child(a), child(b)
        bad = written(a.join(b, ["file", "no"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "no"), f"merkle-differs-{k}")
    ranges = bad.withColumnRenamed("no", "range")
    sides = [
        side.join(ranges, ["file", "range"], "left_semi").select("file", "offset", "copy", F.col("length").alias(f"{n}_length"), F.col("sha256").alias(f"{n}_sha256"))
        for side, n in ((left, "left"), (right, "right"))]
    at, kinds = ["file", "offset", "copy"], ("left", "right")
    differs = ~(F.col("left_sha256").eqNullSafe(F.col("right_sha256")) & F.col("left_length").eqNullSafe(F.col("right_length")))
    both = written(sides[0].join(sides[1], at, "full").where(differs), "merkle-records")
    # Equal records of both sides are paired in order; both ranges of a moved record differ, so none is overlooked.
    turn = Window.partitionBy("file", "sha256", "length").orderBy("offset", "copy")
    left, right = (
        both.where(F.col(f"{n}_sha256").isNotNull()).select(*at, F.col(f"{n}_length").alias("length"), F.col(f"{n}_sha256").alias("sha256")).withColumn(
            "turn", F.row_number().over(turn)) for n in kinds)
    there = right.select(*[F.col(c).alias(f"_{c}") for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("file", "sha256", "length", "turn")]
    moved = written(left.join(there, same).select(
        *at, "length", "sha256", F.col("_offset").alias("right_offset"), F.col("_copy").alias("right_copy")), "merkle-moved")
    sides = [
        side.join(moved.select("file", F.col(f"{p}offset").alias("offset"), F.col(f"{p}copy").alias("copy")), at, "left_anti").select(
            *at, F.col("length").alias(f"{n}_length"), F.col("sha256").alias(f"{n}_sha256"))
        for side, n, p in ((left, "left", ""), (right, "right", "right_"))]
    status = F.when(F.col("right_sha256").isNull(), "missing").when(F.col("left_sha256").isNull(), "extra").otherwise("changed")
    rest = sides[0].join(sides[1], at, "full").select(
        *at, status.alias("status"), "left_length", "left_sha256", "right_length", "right_sha256", F.lit(None).cast("long").alias("right_offset"))
    return rest.union(moved.select(*at, F.lit("moved"), "length", "sha256", "length", "sha256", "right_offset"))


def warc_records(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """file, offset, page_id, payload: pages as WARC response records, ``per_file`` ids in a file, in the order of their ids."""
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col("url"), F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    rows = pages.select(
        "page_id", F.concat(F.lit("segment-"), F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("string"), F.lit(".warc")).alias("file"),
        F.concat(head, body, F.lit("\r\n\r\n")).alias("payload"))
    before = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "payload").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", F.coalesce(F.sum(F.octet_length("payload").cast("long")).over(before), F.lit(0).cast("long")).alias("offset"), "page_id", "payload")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with deterministic faults: a changed first byte, a lost tail, a lost record, each in one of 97 records."""
    draw = F.coalesce(F.pmod("page_id", F.lit(97)), F.lit(0))
    payload = F.when(draw == 3, F.concat(F.lit("#"), F.substring("payload", 2, 1 << 30))).when(
        draw == 5, F.substring("payload", 1, F.length("payload") - 7)).otherwise(F.col("payload"))
    return records.where(draw != 7).withColumn("payload", payload)
