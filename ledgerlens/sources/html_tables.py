"""Cells of HTML tables with row and column spans."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = r"(?s)<tr[^>]*>(.*?)</tr>"
CELLS = r"(?s)<t[dh]([^>]*)>(.*?)</t[dh]>"


@lru_cache(maxsize=4096)
def columns_of(layout: str) -> str:
    """Column of each cell of a layout: the next one that no earlier row span occupies.

    A layout lists ``rowspan x colspan`` per cell, cells by comma, rows by semicolon; so does the result.
    """
    free_from: dict[int, int] = {}  # column -> first row in which it is free
    out = []
    for r, row in enumerate(layout.split(";")):
        c, cols = 0, []
        for cell in row.split(",") if row else []:
            down, across = map(int, cell.split("x"))
            while free_from.get(c, 0) > r:
                c += 1
            cols.append(str(c))
            for k in range(c, c + across):
                free_from[k] = max(free_from.get(k, 0), r + down)
            c += across
        out.append(",".join(cols))
    return ";".join(out)


@F.pandas_udf(T.StringType())
def place_cells(layouts: pd.Series) -> pd.Series:
    return layouts.map(columns_of)


def html_cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per cell: row and column index, spans, text. Tags are cut by Spark, only the placing runs in Python.

    Documents without a table row never reach Python.
    """
    rows = F.regexp_extract_all(F.col(html), F.lit(ROWS), F.lit(1))
    p = pages.where(F.contains(F.lower(html), F.lit("<tr"))).select(key, rows.alias("rows"))

    def span(attrs, name):
        return F.coalesce(F.nullif(F.regexp_extract(attrs, name + r'\s*=\s*"?(\d+)', 1), F.lit("")), F.lit("1"))

    cells = F.transform("rows", lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELLS), F.lit(0)), lambda c: F.struct(
        F.regexp_extract(c, CELLS, 1).alias("attrs"), F.trim(F.regexp_extract(c, CELLS, 2)).alias("text"))))
    p = p.select(key, cells.alias("cells"))
    p = p.select(key, F.transform("cells", lambda r: F.transform(r, lambda c: F.struct(
        span(c["attrs"], "rowspan").alias("down"), span(c["attrs"], "colspan").alias("across"), c["text"].alias("text")))).alias("cells"))
    layout = F.array_join(F.transform("cells", lambda r: F.array_join(
        F.transform(r, lambda c: F.concat(c["down"], F.lit("x"), c["across"])), ",")), ";")
    placed = p.withColumn("cols", F.split(place_cells(layout), ";"))
    rows = placed.select(key, "cols", F.posexplode("cells").alias("row_idx", "row"))
    each = rows.select(key, "row_idx", F.split(F.get("cols", F.col("row_idx")), ",").alias("cols"), F.posexplode("row").alias("i", "c"))
    return each.select(
        key, "row_idx", F.get("cols", F.col("i")).cast("int").alias("col_idx"), F.col("c.down").cast("int").alias("row_span"),
        F.col("c.across").cast("int").alias("col_span"), F.col("c.text").alias("text"))
