"""Bounded, repeatable samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(doc_id: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


#: Labels that a classifier may have.
MOST_LABELS = 1000


def bounded(rows: DataFrame, label: str, most: int, *keys: str) -> DataFrame:
    """At most about ``most`` rows of each label, chosen by a hash of ``keys``; all of a label that has fewer. Rows of a label whose
    ``keys`` are equal count as one and give one.

    The share of a label is set from exact counts of distinct hashes, so the result has the same size at every size of the input and
    however often a row repeats. Shares are literals in a filter, before anything but hashes moves. More than ``MOST_LABELS`` labels
    are refused.
    """
    distinct = rows.where(F.col(label).isNotNull()).select(label, F.xxhash64(*keys).alias("_hash")).distinct()
    counts = distinct.groupBy(label).count().limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return rows.where("false")
    shares = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(most / r[1]))])
    draw = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < F.try_element_at(shares, F.col(label))).dropDuplicates([label, *keys])
