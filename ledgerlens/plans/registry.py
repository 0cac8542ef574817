"""Registry of runnable queries: name -> (callable, check SQL, inventory ids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.plans import fixtures


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[fixtures.Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(self.build(fixtures.Tables(spark, sf_dir)))


def comparable(df: DataFrame) -> DataFrame:
    """Columns as both engines print them: decimals as doubles, dates and timestamps as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double").alias(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
            c = c.cast("string").alias(f.name)
        out.append(c)
    return df.select(*out)


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, views: str = ""):
    """Register a query under its function name; ``views`` names the derived views the SQL reads."""

    def wrap(fn: Callable[[fixtures.Tables], DataFrame]):
        text = fixtures.with_views(views.split(), sql) if sql else None
        QUERIES[fn.__name__] = Query(fn.__name__, tuple(ids.split()), fn, text)
        return fn

    return wrap
