"""Audit rows from changes: between versions of an entity in time, and between two snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.skew import bucketed_window


def change_of(before: Column, after: Column) -> Column:
    """``insert``, ``update``, ``delete``, or null where nothing changed; a null stands for an entity that is not there."""
    return F.when(before.isNull() & after.isNotNull(), "insert").when(before.isNotNull() & after.isNull(), "delete").when(before != after, "update")


def change_meta(before: Column, after: Column) -> Column:
    """The values before and after as JSON, nulls kept."""
    return F.to_json(F.struct(before.alias("before"), after.alias("after")), {"ignoreNullFields": "false"})


def version_changes(versions: DataFrame) -> DataFrame:
    """entity_id, event_id, action, before, after: a row per version that differs from the one before it.

    versions: entity_id, event_id, event_time, value (null: deleted). Entities are cut by day, so one that changes all the time is no
    single task's work.
    """
    seen = bucketed_window(versions, ["entity_id"], ["event_time", "event_id"], F.to_date("event_time"), previous={"before": F.col("value")})
    changed = seen.select("entity_id", "event_id", change_of(F.col("before"), F.col("value")).alias("action"), "before", F.col("value").alias("after"))
    return changed.where(F.col("action").isNotNull())


def snapshot_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, action, meta: what differs between two snapshots of a table with unique keys, null-safe in keys and values.

    ``meta`` holds the changed columns only, before and after. One full outer join on the keys.
    """
    old = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*columns).alias("_old"))
    new = after.select(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)], F.struct(*columns).alias("_new"))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(f"_n{i}")) for i in range(len(keys))]
    joined = old.join(new, same, "full_outer")
    there, here = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    pairs = [(c, F.col(f"_old.`{c}`"), F.col(f"_new.`{c}`")) for c in columns]
    differs = [~o.eqNullSafe(n) for _, o, n in pairs]
    changed = differs[0]
    for d in differs[1:]:
        changed = changed | d
    action = F.when(~there, "insert").when(~here, "delete").when(changed, "update")

    def kept(side: int) -> Column:
        values = [F.when(d, F.struct(F.lit(p[0]).alias("key"), p[side].cast("string").alias("value"))) for p, d in zip(pairs, differs, strict=True)]
        return F.map_from_entries(F.filter(F.array(*values), lambda e: e.isNotNull()))

    key = [F.when(there, F.col(f"_k{i}")).otherwise(F.col(f"_n{i}")).alias(k) for i, k in enumerate(keys)]
    out = joined.select(*key, action.alias("action"), change_meta(F.when(there, kept(1)), F.when(here, kept(2))).alias("meta"))
    return out.where(F.col("action").isNotNull())
