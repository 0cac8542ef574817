"""Ordered per-key calculations that never put a whole key into one task.

A window over ``keys`` alone sorts every row of a hot key in a single task. The helpers here cut
each key by an ordered bucket (a day of the event time, say), run the window inside
(key, bucket), and carry only one summary row per (key, bucket) across the bucket edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def bucketed_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add lag (``previous``), lead (``following``) and running-sum columns along ``order``.

    ``bucket`` must not decrease along ``order``. Null keys form a key of their own; nulls of the order columns and a null bucket
    come first.
    """
    previous, following, running = previous or {}, following or {}, running or {}
    cut = df.withColumn(BUCKET, bucket)
    part = [*keys, BUCKET]
    edge = F.struct(*order)

    summary = cut.groupBy(*part).agg(
        *[F.max_by(F.struct(c.alias("v")), edge).alias(f"__last_{n}") for n, c in previous.items()],
        *[F.min_by(F.struct(c.alias("v")), edge).alias(f"__first_{n}") for n, c in following.items()],
        *[F.sum(c).alias(f"__total_{n}") for n, c in running.items()],
        F.lit(1).alias("__one"),
    )
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *part,
        *[F.lag(f"__last_{n}").over(across).alias(f"__prev_{n}") for n in previous],
        *[F.lead(f"__first_{n}").over(across).alias(f"__next_{n}") for n in following],
        *[F.coalesce(F.sum(f"__total_{n}").over(before), F.lit(0)).alias(f"__base_{n}") for n in running],
    )

    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select(
        "*",
        *[F.lag(F.struct(c.alias("v"))).over(inside).alias(f"__lag_{n}") for n, c in previous.items()],
        *[F.lead(F.struct(c.alias("v"))).over(inside).alias(f"__lead_{n}") for n, c in following.items()],
        *[F.sum(c).over(upto).alias(f"__run_{n}") for n, c in running.items()],
    )
    # Null-safe: a row without a key or an order value keeps its place.
    there = summary.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(part)], *[c for c in summary.columns if c not in part])
    same = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(part)]
    joined = local.join(there, same)
    return joined.select(
        *df.columns,
        *[F.coalesce(f"__lag_{n}", f"__prev_{n}").getField("v").alias(n) for n in previous],
        *[F.coalesce(f"__lead_{n}", f"__next_{n}").getField("v").alias(n) for n in following],
        *[(F.col(f"__base_{n}") + F.col(f"__run_{n}")).alias(n) for n in running],
    )


def rank_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """``row_number`` per key, split by bucket."""
    return bucketed_window(df, keys, order, bucket, running={out: F.lit(1).cast("long")})


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark limits each group before the shuffle, so a hot key sends k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def nested_parts(df: DataFrame, key: str, row_key: str, item: Column, out: str, part_size: int = 10000) -> DataFrame:
    """Collect items per key into arrays of about ``part_size``: a big key gets several rows (``part``)."""
    sizes = df.groupBy(key).agg(F.count("*").alias("__n"))
    parts = F.ceil(F.col("__n") / F.lit(part_size))
    return (
        df.join(sizes, key)
        .withColumn("part", F.pmod(F.xxhash64(row_key), parts).cast("int"))
        .groupBy(key, "part")
        .agg(F.sort_array(F.collect_list(item)).alias(out))
    )
