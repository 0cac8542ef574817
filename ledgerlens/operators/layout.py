"""Tables and values out of OCR boxes (page_id, box_id, text, x_min, y_min, x_max, y_max).

Every step is keyed by ``keys``: by page where a page is one table, by page and cluster (``clustered``) where it may hold
several. The boxes are shuffled once by these keys (``by_table``); summaries, header columns and cells of a table are made and
merged where its boxes are. A summary per table grows with the input, so it is never broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.geometry import axis_gap, cells, center
from ledgerlens.session import cut_lineage, written

NEAR = 50.0
ROW_GAP = 10.0
MIN_CELLS = 4
PAGE = ("page_id",)
TABLE = ("page_id", "cluster_id")

# Words that mark a header cell.
HEADER_WORDS = ["item", "description", "qty", "quantity", "price", "unit", "amount", "total", "name", "product", "code",
                "sku", "qta", "số lượng", "đơn giá", "thành tiền"]

# Standard column names, in order of preference, with their words and confidence.
COLUMN_WORDS: list[tuple[str, list[str], float]] = [
    ("item_name", ["item", "name", "product", "hàng", "sản phẩm"], 0.95),
    ("quantity", ["quantity", "qty", "qta", "số lượng", "sl"], 0.95),
    ("unit_price", ["price", "unit cost", "đơn giá", "giá"], 0.95),
    ("amount", ["amount", "total", "sum", "thành tiền", "cộng"], 0.95),
    ("description", ["description", "desc", "notes", "ghi chú"], 0.90),
]
NUMERIC_COLUMNS = ["quantity", "unit_price", "amount"]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def standard_column(text: Column) -> Column:
    """struct<name, confidence> for a header text; unknown texts are descriptions at 0.6."""
    t = F.lower(F.trim(text))
    out = None
    for name, words, conf in COLUMN_WORDS:
        hit = F.struct(F.lit(name).alias("name"), F.lit(conf).alias("confidence"))
        out = F.when(contains_any(t, words), hit) if out is None else out.when(contains_any(t, words), hit)
    return out.otherwise(F.struct(F.lit("description").alias("name"), F.lit(0.6).alias("confidence")))


def with_check(cell: DataFrame, text: Column, column: Column) -> DataFrame:
    """Adds is_valid, number and confidence: text columns always pass, number columns need a number, which is searched there only and once."""
    is_number_column = column.isin(NUMERIC_COLUMNS)
    found = F.replace(F.regexp_extract(F.trim(text), r"[\d.,]+", 0), F.lit(","), F.lit("."))
    d = cell.withColumn("found", F.when(F.coalesce(~is_number_column, F.lit(False)), None).otherwise(found))
    d = d.withColumn("parsed", F.when(F.col("found").rlike(r"^(\d+\.?\d*|\.\d+)$"), F.col("found").try_cast("decimal(20,4)")))
    known = F.col("parsed").isNotNull()
    return d.withColumns({
        "is_valid": ~is_number_column | known, "number": F.when(is_number_column, F.col("parsed")),
        "confidence": F.when(is_number_column, F.when(known, 0.95).otherwise(0.1)).otherwise(0.9)}).drop("found", "parsed")


def by_table(boxes: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Boxes shuffled by table, so that no later step by table shuffles them again."""
    return boxes.repartition(*keys)


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a frame of a row per table, without a broadcast however small the optimizer thinks it is."""
    return left.join(right.hint("merge"), [*keys], how)


def regions(boxes: DataFrame, min_cells: int = MIN_CELLS, keys: Sequence[str] = PAGE) -> DataFrame:
    """Bounding region per table; fewer than ``min_cells`` boxes make no table."""
    return boxes.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.min("x_min").alias("rx_min"), F.min("y_min").alias("ry_min"),
        F.max("x_max").alias("rx_max"), F.max("y_max").alias("ry_max")).where(F.col("cells") >= min_cells)


def row_boxes(cells_df: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Box around each row."""
    return cells_df.groupBy(*keys, "row_idx").agg(
        F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"),
        F.max("y_max").alias("y_max"), F.count("*").alias("cells"))


def row_islands(boxes: DataFrame, gap: float = ROW_GAP) -> DataFrame:
    """Row number per box: sorted by vertical centre, a step of ``gap`` or more starts a new row.

    The window runs over distinct heights of a page, not over its boxes.
    """
    b = boxes.withColumn("yc", center(F.col("y_min"), F.col("y_max")))
    heights = b.select("page_id", "yc").distinct()
    w = Window.partitionBy("page_id").orderBy("yc")
    step = F.col("yc") - F.lag("yc").over(w)
    starts = heights.withColumn("new", F.when(step >= gap, 1).otherwise(0))
    rows = starts.withColumn("row_idx", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return b.join(rows.drop("new"), ["page_id", "yc"])


def row_groups_exact(boxes: DataFrame, threshold: float = ROW_GAP) -> DataFrame:
    """Order-exact row grouping: a box joins the first row whose running mean height is within ``threshold``.

    Pages stream through their task in box order; only the sums of the current page's rows are held.
    """

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, sums, counts = None, [], []
        for pdf in frames:
            out = []
            for p, y in zip(pdf.page_id.tolist(), ((pdf.y_min + pdf.y_max) / 2).tolist()):
                if p != page:
                    page, sums, counts = p, [], []
                row = next((i for i, (s, n) in enumerate(zip(sums, counts)) if abs(y - s / n) < threshold), None)
                if row is None:
                    row = len(sums)
                    sums.append(0.0)
                    counts.append(0)
                sums[row] += y
                counts[row] += 1
                out.append(row)
            yield pdf[["page_id", "box_id"]].assign(row_idx=out)

    ordered = boxes.select("page_id", "box_id", "y_min", "y_max").repartition("page_id").sortWithinPartitions("page_id", "box_id")
    return ordered.mapInPandas(assign, "page_id long, box_id long, row_idx int")


def _placed(rows: DataFrame, gap: float, keys: Sequence[str]) -> DataFrame:
    """Adds ``place`` (rows that start up to here, the first of a table always does) and ``row_idx`` (rows of a known height before it) by ``yc``."""
    w = Window.partitionBy(*keys).orderBy("yc")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("yc") - F.lag("yc").over(w)
    rows = rows.withColumn("starts", F.when((F.row_number().over(w) == 1) | ((step >= gap) & (step > 0)), 1).otherwise(0))
    known = F.when(F.col("yc").isNotNull(), F.col("starts")).otherwise(0)
    return rows.select("*", F.sum("starts").over(upto).cast("int").alias("place"), (F.sum(known).over(upto) - 1).cast("int").alias("row_idx")).drop("starts")


def _totals(candidates: int, n: Column, marked: Column, chars: Column, sides: Sequence[str]) -> dict[str, Column]:
    """Aggregates of a table: region, rows, and the sizes of its first rows."""
    x0, y0, x1, y1 = sides
    first = F.col("place") <= candidates
    out = {"cells": F.sum(n), "rx_min": F.min(x0), "ry_min": F.min(y0), "rx_max": F.max(x1), "ry_max": F.max(y1), "num_rows": F.max("place")}
    for r in range(candidates):
        here = first & (F.col("row_idx") == r)
        out |= {f"n_{r}": F.sum(F.when(here, n)), f"marked_{r}": F.sum(F.when(here, marked)), f"chars_{r}": F.sum(F.when(here, chars))}
    return out


def _with_header(tables: DataFrame, candidates: int) -> DataFrame:
    """header_row and header_confidence instead of the sizes: the best scored of the first rows; a single row is row 0 at confidence 0.5."""

    def scored(r):
        n = F.col(f"n_{r}")
        position = F.lit(1.0) - F.lit(r) / (F.col("num_rows") + 1)
        length = F.when(F.try_divide(f"chars_{r}", n).between(5, 30), 1.0).otherwise(0.6)
        points = F.try_divide(F.col(f"marked_{r}"), n) * 0.5 + position * 0.3 + length * 0.2
        return F.when(F.col("num_rows") > r, F.struct(points.alias("score"), F.lit(-r).alias("turn")))

    best, single = F.array_max(F.array(*[scored(r) for r in range(candidates)])), F.col("num_rows") < 2
    sizes = [f"{c}_{r}" for c in ("n", "marked", "chars") for r in range(candidates)]
    return tables.withColumn("best", best).withColumns({
        "header_row": F.when(single, 0).otherwise(-F.col("best.turn")),
        "header_confidence": F.when(single, 0.5).otherwise(F.least(F.lit(1.0), F.col("best.score") * 1.2))}).drop("best", "cells", "place", *sizes)


def page_summary(
    boxes: DataFrame, gap: float = ROW_GAP, min_cells: int = MIN_CELLS, candidates: int = 3, keys: Sequence[str] = PAGE,
) -> DataFrame:
    """One row per table: region, number of rows, header row and its confidence.

    Boxes shrink to one row per (table, height) before they meet per table.
    """
    heights = boxes.groupBy(*keys, center(F.col("y_min"), F.col("y_max")).alias("yc")).agg(
        F.count("*").alias("n"), F.count_if(contains_any(F.lower("text"), HEADER_WORDS)).alias("marked"), F.sum(F.length("text")).alias("chars"),
        F.min("x_min").alias("x0"), F.min("y_min").alias("y0"), F.max("x_max").alias("x1"), F.max("y_max").alias("y1"))
    totals = _totals(candidates, F.col("n"), F.col("marked"), F.col("chars"), ["x0", "y0", "x1", "y1"])
    page = _placed(heights, gap, keys).groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]).where(F.col("cells") >= min_cells)
    return _with_header(page, candidates)


def with_rows(boxes: DataFrame, gap: float = ROW_GAP, min_cells: int = MIN_CELLS, keys: Sequence[str] = PAGE, candidates: int = 3) -> DataFrame:
    """Boxes of tables with ``row_idx`` and the table's summary, by windows over the boxes of a table: one shuffle, no join."""
    b = by_table(boxes, keys).withColumns({"xc": center(F.col("x_min"), F.col("x_max")), "yc": center(F.col("y_min"), F.col("y_max"))})
    words = F.lower("text").rlike("|".join(map(re.escape, HEADER_WORDS))).cast("int")
    totals = _totals(candidates, F.lit(1), F.coalesce("marked", F.lit(0)), F.length("text"), ["x_min", "y_min", "x_max", "y_max"])
    table = Window.partitionBy(*keys)
    b = _placed(b, gap, keys).withColumn("marked", F.when(F.col("row_idx") < candidates, words)).select("*", *[c.over(table).alias(n) for n, c in totals.items()]).where(F.col("cells") >= min_cells)
    return _with_header(b, candidates).drop("marked")


def header_rows(boxes: DataFrame) -> DataFrame:
    return page_summary(boxes).select("page_id", "header_row", "header_confidence")


def header_columns(rowed: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Columns of the header row in order: x range from this header to the next, the last to the region's edge."""
    h = rowed.where(F.col("row_idx") == F.col("header_row"))
    w = Window.partitionBy(*keys).orderBy("xc", "box_id")
    name = standard_column(F.col("text"))
    return h.select(
        *keys, (F.row_number().over(w) - 1).alias("col_idx"), F.col("text").alias("detected_name"),
        name["name"].alias("standard_name"), name["confidence"].alias("name_confidence"), F.col("x_min").alias("c_min"),
        F.coalesce(F.lead("x_min").over(w), F.col("rx_max")).alias("c_max"))


def with_columns(rowed: DataFrame, keys: Sequence[str] = PAGE, names: bool = False) -> DataFrame:
    """Adds ``cols``, the columns of the table's header row in order (as ``header_columns`` gives them), to the boxes of ``with_rows``.

    A window over the table where its boxes already are, so the boxes are not read again to be joined with their columns. ``names``: with the
    detected names and their confidences.
    """
    head = F.col("row_idx") == F.col("header_row")
    more = {"detected_name": F.col("text"), "name_confidence": F.col("named.confidence")} if names else {}
    found = rowed.withColumn("named", F.when(head, standard_column(F.col("text")))).withColumn("heads", F.sort_array(F.collect_list(F.when(head, F.struct(
        "xc", "box_id", "x_min", F.col("named.name").alias("standard_name"), *[c.alias(n) for n, c in more.items()]))).over(Window.partitionBy(*keys))))
    return found.where(F.size("heads") > 0).withColumn("cols", F.transform("heads", lambda h, i: F.struct(
        i.alias("col_idx"), h["x_min"].alias("c_min"), F.coalesce(F.get("heads", i + 1)["x_min"], F.col("rx_max")).alias("c_max"),
        h["standard_name"].alias("standard_name"), *[h[n].alias(n) for n in more]))).drop("heads", "named")


def assign_columns(cells_df: DataFrame) -> DataFrame:
    """Column per cell out of ``cols``: the first that contains the cell's centre, else the nearest column centre."""
    xc = F.col("xc")
    ranked = F.transform("cols", lambda c: F.struct(
        F.when((c["c_min"] <= xc) & (xc <= c["c_max"]), 0.0).otherwise(1.0).alias("outside"),
        F.when((c["c_min"] <= xc) & (xc <= c["c_max"]), 0.0).otherwise(F.abs(xc - (c["c_min"] + c["c_max"]) / 2)).alias("distance"),
        c["col_idx"].alias("col_idx"), c["standard_name"].alias("standard_name")))
    return cells_df.withColumn("best", F.array_min(ranked)).withColumns(
        {"col_idx": F.col("best.col_idx"), "standard_name": F.col("best.standard_name")}).drop("best", "cols")


def table_cells(boxes: DataFrame, gap: float = ROW_GAP, min_cells: int = MIN_CELLS, keys: Sequence[str] = PAGE) -> DataFrame:
    """Data cells of each table: the longest text per (row, column), the header row left out."""
    return cells_of(with_rows(boxes, gap, min_cells, keys), keys)


def cells_of(rowed: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    known = rowed.where(" and ".join(f"{k} is not null" for k in keys))
    placed = assign_columns(with_columns(known, keys).where(F.col("row_idx") != F.col("header_row")))
    return _checked(placed.groupBy(*keys, "row_idx", "col_idx").agg(*_cell()), keys)


def _cell() -> list[Column]:
    return [F.max_by(F.struct("text", "standard_name"), F.struct(F.length("text"), -F.col("box_id"))).alias("c"),
            F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max")]


def _checked(cell: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = cell.select(
        *keys, "row_idx", "col_idx", F.col("c.standard_name").alias("standard_name"), F.col("c.text").alias("value"), "x_min", "y_min", "x_max", "y_max")
    return with_check(found, F.col("value"), F.col("standard_name"))


#: What a table has once.
REGION = ["rx_min", "ry_min", "rx_max", "ry_max", "header_row", "header_confidence"]


def table_parts(rowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of tables, and a row per table (``header``: region, header and columns, else null), so the windows over the boxes run once for both."""
    known = rowed.where(" and ".join(f"{k} is not null" for k in keys))
    head = F.col("row_idx") == F.col("header_row")
    found = with_columns(known, keys, names=True).withColumn("header", F.when(head, F.struct("cols", *REGION)))
    placed = assign_columns(found.withColumn("cols", F.when(~head, F.col("cols"))))  # header boxes get no column
    return placed.groupBy(*keys, "row_idx", "col_idx").agg(*_cell(), F.first("header", ignorenulls=True).alias("header"))


def row_confidence(cells_df: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Mean cell confidence and validity per row. Confidences are hundredths, so the sum is exact."""
    hundredths = F.round(F.col("confidence") * 100).cast("long")
    return cells_df.groupBy(*keys, "row_idx").agg(
        F.count("*").alias("cells"), F.count_if(~F.col("is_valid")).alias("invalid_cells"),
        (F.sum(hundredths) / F.count("*") / 100).alias("row_confidence"))


def row_totals(cells_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, cells and the sum of row confidences (in millionths) per table."""
    return row_confidence(cells_df, keys).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum("cells").alias("cells"),
        F.sum(F.round(F.col("row_confidence") * 1000000).cast("long")).alias("micro"))


def extracted_tables(boxes: DataFrame) -> DataFrame:
    """One row per page: is there a table, its size and confidences."""
    rows = row_totals(table_cells(boxes), PAGE)
    pages = by_table(boxes).select("page_id").distinct()
    n = F.coalesce("rows", F.lit(0))
    return merged(pages, rows, PAGE, "left").select(
        "page_id", F.col("rows").isNotNull().alias("table_found"), n.alias("rows"), F.coalesce("cells", F.lit(0)).alias("cells"),
        F.coalesce(F.col("micro") / F.col("rows") / 1000000, F.lit(0.0)).alias("overall_confidence"),
        F.least(F.lit(1.0), n / 10).alias("table_confidence"))


def clustered(boxes: DataFrame, distance: float = NEAR) -> DataFrame:
    """Boxes with the ``cluster_id`` of the table they belong to, written once because every later step reads them.

    Clusters of a page of at most ``PAGE_BOXES`` boxes are found where the page's boxes lie; larger pages go by rounds of joins over all tasks.
    """
    kept = boxes.where("page_id is not null and box_id is not null")
    found = written(by_page(kept, "cluster_id", near_labels, distance), "clusters")
    large = found.where("cluster_id is null").drop("cluster_id")
    if large.isEmpty():
        return found
    return found.where("cluster_id is not null").unionByName(large.join(cluster_rounds(large, distance), ["page_id", "box_id"]))


class PageTables:
    """All tables of all pages, each keyed by (page_id, cluster_id). What several of its frames are made of is written once."""

    def __init__(self, rowed: DataFrame):
        self.rowed = rowed

    @cached_property
    def parts(self) -> DataFrame:
        return written(table_parts(self.rowed, TABLE), "tables")

    @cached_property
    def headers(self) -> DataFrame:
        return self.parts.where("header is not null").select(*TABLE, "header.*")

    @cached_property
    def columns(self) -> DataFrame:
        return self.headers.select(*TABLE, F.inline("cols")).select(*TABLE, "col_idx", "detected_name", "standard_name", "name_confidence", "c_min", "c_max")

    @cached_property
    def cells(self) -> DataFrame:
        """Alone they are not written."""
        return _checked(self.parts.where("header is null"), TABLE) if "parts" in self.__dict__ else cells_of(self.rowed, TABLE)

    @cached_property
    def tables(self) -> DataFrame:
        n, totals = F.coalesce("rows", F.lit(0)), row_totals(_checked(self.parts.where("header is null"), TABLE), TABLE)
        return merged(self.headers.withColumn("columns", F.size("cols")), totals, TABLE, "left").select(
            *TABLE, *REGION, "columns", n.alias("rows"),
            F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce(F.col("micro") / F.col("rows") / 1000000, F.lit(0.0)).alias("overall_confidence"),
            F.least(F.lit(1.0), n / 10).alias("table_confidence"))


def page_tables(boxes: DataFrame, gap: float = ROW_GAP, min_cells: int = MIN_CELLS, distance: float = NEAR) -> PageTables:
    """Every table of a page: boxes cluster by nearness, a cluster of ``min_cells`` boxes is a table of its own.

    tables: region, header row, numbers of columns, rows and cells, confidences. A header without rows is a table with no rows and
    confidence 0. Boxes with a null page or coordinate have no neighbours; a null page has no table.
    """
    return PageTables(with_rows(clustered(boxes.where("page_id is not null"), distance), gap, min_cells, TABLE))


def column_detection(found: PageTables) -> DataFrame:
    """Per standard column: how many of the rows that could have it do, and the mean confidence there.

    A column counts the rows of the tables whose header names it, once per header cell of that name; of a row's cells under one name
    the last column's counts.
    """
    possible = merged(found.columns, found.tables.select(*TABLE, "rows"), TABLE).groupBy("standard_name").agg(F.sum("rows").alias("possible"))
    hundredths = F.round(F.col("confidence") * 100).cast("long")
    last = found.cells.groupBy(*TABLE, "row_idx", "standard_name").agg(F.max_by("confidence", "col_idx").alias("confidence"))
    cells_df = last.groupBy("standard_name").agg(F.count("*").alias("extracted"), (F.sum(hundredths) / F.count("*") / 100).alias("avg_confidence"))
    n = F.coalesce("extracted", F.lit(0))
    return possible.join(cells_df, "standard_name", "left").select(
        "standard_name", "possible", n.alias("extracted"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.try_divide(n, F.col("possible")), F.lit(0.0)).alias("detection_rate"))


def method_statistics(cells_df: DataFrame) -> DataFrame:
    """Per standard column and extraction ``method``: values and their mean confidence (null confidences don't count)."""
    hundredths = F.round(F.col("confidence") * 100).cast("long")
    return cells_df.groupBy("standard_name", "method").agg(
        F.count("*").alias("total_extracted"), (F.sum(hundredths) / F.count(hundredths) / 100).alias("avg_confidence"))


def table_statistics(tables: DataFrame) -> DataFrame:
    return tables.agg(
        F.count("*").alias("documents"), F.count_if("table_found").alias("tables_found"),
        (F.count_if("table_found") / F.count("*")).alias("detection_rate"), F.sum("rows").alias("rows"),
        F.sum("cells").alias("cells"))


def column_statistics(cells_df: DataFrame) -> DataFrame:
    """Per standard column: cells and mean confidence; the rate is over all table rows.

    Cells are read once: the first cell of each row stands for the row, so rows are counted beside the cells.
    """
    hundredths = F.round(F.col("confidence") * 100).cast("long")
    rows = cells_df.groupBy("page_id", "row_idx").agg(F.collect_list(F.struct("standard_name", hundredths.alias("hundredths"))).alias("cells"))
    names = rows.select(F.posexplode("cells").alias("place", "cell")).groupBy(F.col("cell.standard_name").alias("standard_name")).agg(
        F.count("*").alias("total_extracted"), (F.sum("cell.hundredths") / F.count("*") / 100).alias("avg_confidence"),
        F.count_if(F.col("place") == 0).alias("first_cells"))
    every = F.sum("first_cells").over(Window.partitionBy(F.lit(1)))  # a row per standard column
    return names.select("standard_name", "total_extracted", "avg_confidence", every.alias("total_rows")).withColumn(
        "detection_rate", F.col("total_extracted") / F.col("total_rows"))


# Neighbours and clusters

GRID = 200.0


def _spread(boxes: DataFrame, pad: float, grid: float) -> DataFrame:
    """Each box once per grid cell that its padded rectangle touches."""
    return boxes.withColumn("gx", F.explode(cells(F.col("x_min") - pad, F.col("x_max") + pad, grid))).withColumn(
        "gy", F.explode(cells(F.col("y_min") - pad, F.col("y_max") + pad, grid)))


def near_pairs(boxes: DataFrame, distance: float = NEAR, grid: float = GRID) -> DataFrame:
    """Pairs of boxes (a before b) of a page whose gaps are below ``distance`` on both axes.

    Near boxes have overlapping rectangles once each is padded by half the distance, so an equi-join
    on (page, grid cell) finds them; a pair counts only in the first cell both share.
    """
    pad = distance / 2
    cols = ["page_id", "box_id", "x_min", "y_min", "x_max", "y_max"]
    s = _spread(boxes.select(*cols), pad, grid)
    a = s.select("page_id", "gx", "gy", *[F.col(c).alias(f"a_{c}") for c in cols[1:]])
    b = s.select("page_id", "gx", "gy", *[F.col(c).alias(f"b_{c}") for c in cols[1:]])

    def c(side, name):
        return F.col(f"{side}_{name}")

    first_x = F.floor((F.greatest(c("a", "x_min"), c("b", "x_min")) - pad) / grid)
    first_y = F.floor((F.greatest(c("a", "y_min"), c("b", "y_min")) - pad) / grid)
    gap_x = axis_gap(c("a", "x_min"), c("a", "x_max"), c("b", "x_min"), c("b", "x_max"))
    gap_y = axis_gap(c("a", "y_min"), c("a", "y_max"), c("b", "y_min"), c("b", "y_max"))
    j = a.join(b, ["page_id", "gx", "gy"]).where(
        (c("a", "box_id") < c("b", "box_id")) & (F.col("gx") == first_x) & (F.col("gy") == first_y)
        & (gap_x < distance) & (gap_y < distance))
    return j.select("page_id", c("a", "box_id").alias("a"), c("b", "box_id").alias("b"), gap_x.alias("gap_x"), gap_y.alias("gap_y"))


#: Boxes of a page that are compared in one task; pages with more are compared by joins over grid cells. Pairs compared at a time.
PAGE_BOXES, PAIRS = 1000, 1_000_000


def whole_pages(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, starts of pages, whether a page is whole) of batches sorted by page. Pages above ``most`` rows come in parts that are not whole."""
    held, large = None, None  # rows of the page at the end of a batch, or its id once it has too many
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        page = t.column("page_id")
        cuts = np.flatnonzero(pc.not_equal(page.slice(1), page.slice(0, len(page) - 1)).to_numpy()) + 1 if len(page) > 1 else np.zeros(0, np.int64)
        starts = np.concatenate([[0], cuts]).astype(np.int64)
        whole = np.diff(np.append(starts, len(page))) <= most
        if large is not None and held is None:
            whole[0] &= page[0] != large
        if whole[-1]:
            held, end, n = t.slice(starts[-1]), int(starts[-1]), len(starts) - 1
        else:
            held, large, end, n = None, page[-1], len(page), len(starts)
        if n:
            yield t.slice(0, end), starts[:n], whole[:n]
    if held is not None:
        yield held, np.zeros(1, np.int64), np.ones(1, bool)


def page_pairs(rows: pa.Table, starts: np.ndarray, whole: np.ndarray, distance: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, a, b) of runs of whole pages: the pairs of rows a < b of a page whose gaps are below ``distance`` on both axes."""
    low_x, high_x, low_y, high_y = (rows.column(c).cast(pa.float64()).to_numpy() for c in ("x_min", "x_max", "y_min", "y_max"))
    ends = np.append(starts[1:], rows.num_rows)
    starts, ends = starts[whole], ends[whole]
    sizes = ends - starts
    run = np.cumsum(sizes * (sizes - 1) // 2) // PAIRS
    first = np.flatnonzero(np.diff(run, prepend=-1))
    for i, j in zip(first, np.append(first[1:], len(starts))):
        n = sizes[i:j]
        row = np.repeat(starts[i:j] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        place = row - np.repeat(starts[i:j], n)
        b = np.repeat(row, place)
        a = np.repeat(row - place, place) + np.arange(len(b)) - np.repeat(np.cumsum(place) - place, place)

        def gap(low, high):
            return np.minimum(np.minimum(np.abs(low[a] - high[b]), np.abs(low[b] - high[a])), np.abs((low[a] + high[a]) / 2 - (low[b] + high[b]) / 2))

        near = (gap(low_x, high_x) < distance) & (gap(low_y, high_y) < distance)
        yield int(starts[i]), int(ends[j - 1]), a[near], b[near]


def near_labels(rows: pa.Table, starts: np.ndarray, whole: np.ndarray, distance: float) -> np.ndarray:
    """``cluster_id`` per row (see ``cluster_rounds``); rows come by page and box. Rows of one box id have one label."""
    ids = rows.column("box_id").to_numpy()
    first = np.append(True, ids[1:] != ids[:-1])
    first[starts] = True
    first = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    label = first.copy()
    for _, _, a, b in page_pairs(rows, starts, whole, distance):
        a, b = first[a], first[b]
        a, b = a[a < b], b[a < b]
        at = np.flatnonzero(np.diff(b, prepend=-1))
        while len(at):
            new = np.minimum(label[b[at]], np.minimum.reduceat(label[a], at))
            new = np.minimum(new, label[new])
            if (new == label[b[at]]).all():
                break
            label[b[at]] = new
    return ids[label[first]]


def near_counts(rows: pa.Table, starts: np.ndarray, whole: np.ndarray, distance: float) -> np.ndarray:
    """Number of near rows per row."""
    out = np.zeros(rows.num_rows, np.int64)
    for low, high, a, b in page_pairs(rows, starts, whole, distance):
        out[low:high] += np.bincount(a - low, minlength=high - low) + np.bincount(b - low, minlength=high - low)
    return out


def by_page(boxes: DataFrame, name: str, value: Callable[[pa.Table, np.ndarray, np.ndarray, float], np.ndarray], distance: float, most: int | None = None) -> DataFrame:
    """Boxes with a long column that ``value`` makes of whole pages, null on pages of more than ``most`` boxes.

    Pages stream through their task sorted; a page that has too many boxes is let go as soon as this is seen.
    """
    most = PAGE_BOXES if most is None else most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, whole in whole_pages(batches, most):
            rows = rows.combine_chunks()
            sizes = np.diff(np.append(starts, rows.num_rows))
            found = pa.array(value(rows, starts, whole, distance), pa.int64(), mask=~np.repeat(whole, sizes))
            yield from rows.append_column(name, found).to_batches()

    fields = ", ".join(f"`{n}` {k}" for n, k in boxes.dtypes)
    return boxes.repartition("page_id").sortWithinPartitions("page_id", "box_id").mapInArrow(scan, f"{fields}, `{name}` long")


def neighbour_counts(boxes: DataFrame, distance: float = NEAR) -> DataFrame:
    """Number of near boxes per box: where the page's boxes lie, for pages above ``PAGE_BOXES`` by joins over grid cells."""
    rect = ["page_id", "x_min", "y_min", "x_max", "y_max"]
    found = written(by_page(boxes.select("box_id", *rect).dropna(subset=rect), "neighbours", near_counts, distance), "neighbours")
    large = found.where("neighbours is null")
    out = found.select("page_id", "box_id", "neighbours")
    if large.isEmpty():
        return out
    return out.where("neighbours is not null").unionByName(neighbour_joins(large.drop("neighbours"), distance))


def neighbour_joins(boxes: DataFrame, distance: float = NEAR) -> DataFrame:
    """Number of near boxes per box, by joins. Equal rectangles of a page collapse to one weighted box first."""
    rect = ["page_id", "x_min", "y_min", "x_max", "y_max"]
    distinct = boxes.groupBy(*rect).agg(F.count("*").alias("copies"), F.min("box_id").alias("box_id"))
    pairs = near_pairs(distinct, distance).select("page_id", "a", "b")
    both = pairs.unionByName(pairs.select("page_id", F.col("b").alias("a"), F.col("a").alias("b")))
    weight = distinct.select("page_id", F.col("box_id").alias("b"), "copies")
    others = both.join(weight, ["page_id", "b"]).groupBy("page_id", F.col("a").alias("box_id")).agg(F.sum("copies").alias("others"))
    per_rect = distinct.join(others, ["page_id", "box_id"], "left").select(
        *rect, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("neighbours"))
    return boxes.select(*rect, F.col("box_id").alias("id")).join(per_rect, rect).select(
        "page_id", F.col("id").alias("box_id"), "neighbours")


def cluster_boxes(boxes: DataFrame, distance: float = NEAR) -> DataFrame:
    """Ordered clustering: a box joins the earliest cluster that holds an earlier near box, else starts one. A row per box."""
    sides = boxes.select("page_id", "box_id", "x_min", "y_min", "x_max", "y_max")
    return clustered(sides, distance).select("page_id", "box_id", "cluster_id")


def cluster_rounds(boxes: DataFrame, distance: float = NEAR) -> DataFrame:
    """page_id, box_id, cluster_id of pages of any size, one row per box id, by joins.

    label(b) = least label among earlier near boxes, else b: repeated for all pages at once until nothing changes. Each round
    also jumps to the label's own label, which is reachable over earlier boxes as well, so rounds grow with the logarithm
    of a chain. No page has to fit into one task.
    """
    edges = cut_lineage(near_pairs(boxes, distance).select("page_id", "a", "b"))
    labels = cut_lineage(boxes.select("page_id", "box_id", F.col("box_id").alias("label")).distinct())
    while True:
        src = labels.select("page_id", F.col("box_id").alias("a"), "label")
        seen = edges.join(src, ["page_id", "a"]).groupBy("page_id", F.col("b").alias("box_id")).agg(F.min("label").alias("seen"))
        jump = labels.select("page_id", F.col("box_id").alias("label"), F.col("label").alias("jumped"))
        step = labels.join(seen, ["page_id", "box_id"], "left").join(jump, ["page_id", "label"])
        new = F.least("label", F.coalesce("seen", "label"), "jumped")
        step = cut_lineage(step.select("page_id", "box_id", new.alias("new"), "label"))
        changed = step.agg(F.bool_or(F.col("new") < F.col("label"))).first()[0]
        labels = step.select("page_id", "box_id", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "cluster_id")


# Values near labels

# Label words per field of the layout stage.
FIELD_LABELS = {
    "invoice_number": ["invoice no", "inv no", "no.", "เลขที่ใบแจ้งหนี้"],
    "invoice_date": ["date", "dated", "issued at", "วันที่"],
    "total_amount": ["total", "grand total", "net amount", "จำนวนเงินรวม"],
    "tax_id": ["tax id", "เลขประจำตัวผู้เสียภาษี"],
    "vendor_name": ["from", "vendor", "supplier", "ผู้ขาย"],
}
REACH = 300.0


def values_near_labels(boxes: DataFrame, labels: dict[str, list[str]] = FIELD_LABELS) -> DataFrame:
    """Nearest fitting box right of a label on its line (weight 1) or below it (weight 0.8).

    Label boxes are spread over the grid cells their search area touches, so the join stays local.
    """
    b = boxes.select("page_id", "box_id", F.lower("text").alias("text"), center(F.col("x_min"), F.col("x_max")).alias("cx"),
                     center(F.col("y_min"), F.col("y_max")).alias("cy"))
    wanted = F.array(*[F.when(contains_any(F.col("text"), words), F.lit(f)) for f, words in labels.items()])
    lab = b.withColumn("field_name", F.explode(F.filter(wanted, lambda x: x.isNotNull()))).select(
        "page_id", "field_name", F.col("box_id").alias("label_id"), F.col("cx").alias("lx"), F.col("cy").alias("ly"))
    lab = lab.withColumn("gx", F.explode(cells(F.col("lx") - 50, F.col("lx") + REACH, REACH))).withColumn(
        "gy", F.explode(cells(F.col("ly") - 20, F.col("ly") + 100, REACH)))
    val = b.withColumns({"gx": F.floor(F.col("cx") / REACH), "gy": F.floor(F.col("cy") / REACH)})
    dx, dy = F.col("cx") - F.col("lx"), F.col("cy") - F.col("ly")
    right = (F.abs(dy) < 20) & (dx > 0) & (dx < 300)
    below = (F.abs(dx) < 50) & (dy > 0) & (dy < 100)
    dist = F.when(right, dx).when(below, dy)
    weight = F.when(right, 1.0).otherwise(0.8)
    fits = F.when(F.col("field_name") == "total_amount", F.col("text").rlike(r"\d")) \
        .when(F.col("field_name") == "invoice_number", F.length("text") > 2).otherwise(F.lit(True))
    j = lab.join(val, ["page_id", "gx", "gy"]).where((right | below) & fits & (F.col("box_id") != F.col("label_id")))
    j = j.withColumns({"dist": dist, "score": weight * (F.lit(1.0) - dist / 500)})
    return j.groupBy("page_id", "field_name", "label_id").agg(
        F.min_by(F.struct("box_id", "text", "dist", "score"), F.struct("dist", "box_id")).alias("v")).select(
        "page_id", "field_name", "label_id", F.col("v.box_id").alias("value_id"), F.col("v.text").alias("value"),
        F.col("v.dist").alias("dist"), F.col("v.score").alias("score"))


def layout_results(boxes: DataFrame, doc_of_page: str = "page_id") -> DataFrame:
    """Layout stage of the staged extraction: best scored value per (document, field)."""
    short = F.coalesce(F.length(F.trim("value")) < 2, F.lit(True))
    conf = (F.when(short, 0.425).otherwise(0.85) * F.col("score")).cast("decimal(5,4)")
    near = values_near_labels(boxes).withColumn("confidence", conf)
    return near.groupBy(F.col(doc_of_page).alias("doc_id"), "field_name").agg(
        F.max_by(F.struct("value", "confidence"), F.struct("confidence", -F.col("label_id"))).alias("b")).select(
        "doc_id", "field_name", "b.*")


# Template zones

#: Level of the cells that list the zones of a template; zones themselves have levels from 0 on.
ZONE_LIST = -1


def apply_zones(fields: DataFrame, zones: Sequence[tuple[str, int, float, float, float, float]]) -> DataFrame:
    """Template zones (label, page, x, y, width, height) over placed fields: new value per (document, label).

    The first field whose centre lies in a zone of its page gives the value, else it is null. The zones
    are literals of the plan; a null page counts as page 1. Existing labels are overwritten.
    """
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    page = F.coalesce("page_number", F.lit(1))
    hits = F.array(*[
        F.when((page == p) & cx.between(x, x + w) & cy.between(y, y + h), F.struct(F.lit(label).alias("label"), F.lit(p).alias("zone_page")))
        for label, p, x, y, w, h in zones])
    found = fields.select("doc_id", "field_id", "field_value", "confidence", F.inline(F.filter(hits, lambda z: z.isNotNull())))
    first = found.groupBy("doc_id", "label", "zone_page").agg(
        F.min_by(F.struct("field_value", "confidence"), "field_id").alias("f"))
    wanted = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(p).alias("zone_page")) for label, p, *_ in zones])
    existing = fields.where(F.col("field_name").isin([z[0] for z in zones])).select(
        "doc_id", F.col("field_name").alias("label"), page.alias("zone_page"), F.lit(True).alias("had")).distinct()
    docs = fields.select("doc_id").distinct().select("doc_id", F.inline(wanted))
    key = ["doc_id", "label", "zone_page"]
    return docs.join(first, key, "left").join(existing, key, "left").select(
        *key, F.col("f.field_value").alias("value"), F.col("f.confidence").alias("confidence"),
        F.coalesce("had", F.lit(False)).alias("replaces_field"))


def zone_upsert(fields: DataFrame, zones: DataFrame, applied: DataFrame) -> DataFrame:
    """The field table after templates were applied: labels that a document has are updated, others are added.

    fields: doc_id, field_id, field_name, field_value, confidence, page_number, x, y, width, height. zones (any number): template_id, sort_order,
    label, page_number, x, y, width, height. applied: doc_id, template_id. The value of a zone is that of the first field (by id) whose centre lies
    in it, null if there is none; of zones with one label and page the last counts. Of several fields with the label the first is updated. A null
    page is page 1. Adds ``change``: kept, updated or added.

    Zones and centres meet in grid cells whose size fits the zone (a power of two), so a zone of any size touches at most four cells. Fields and
    templates are shuffled once, together and by document; values, targets and wanted labels meet in windows inside these partitions.
    """
    page = F.coalesce("page_number", F.lit(1))
    z = zones.withColumn("page_number", page).groupBy("template_id", "label", "page_number").agg(
        F.max_by(F.struct("x", "y", "width", "height"), "sort_order").alias("z")).select(
        "template_id", "label", "page_number", *[F.col(f"z.{c}").alias(f"z_{c}") for c in ("x", "y", "width", "height")])
    page_type = z.schema["page_number"].dataType
    size = F.greatest(F.col("z_width"), F.col("z_height"), F.lit(1.0))
    z = z.withColumn("level", F.ceil(F.log2(size)).cast("int"))
    levels = [r[0] for r in z.select("level").distinct().collect() if r[0] is not None]  # powers of two of a coordinate: few
    unit = F.pow(F.lit(2.0), F.col("level"))
    spread = z.withColumn("gx", F.explode(F.sequence(F.floor(F.col("z_x") / unit), F.floor((F.col("z_x") + F.col("z_width")) / unit)))).withColumn(
        "gy", F.explode(F.sequence(F.floor(F.col("z_y") / unit), F.floor((F.col("z_y") + F.col("z_height")) / unit))))
    # A row of cell (0, 0) of a level that no zone has lists a template's zones for its documents.
    listed = z.withColumns({"level": F.lit(ZONE_LIST), "gx": F.lit(0).cast("long"), "gy": F.lit(0).cast("long")})
    cell = ["template_id", "cell_page", "level", "gx", "gy"]
    lookup = spread.withColumn("cell_page", F.col("page_number")).unionByName(listed.withColumn("cell_page", F.lit(0).cast(page_type))).select(
        *[F.col(c).alias(f"z_{c}") for c in cell], F.col("label").alias("z_label"), F.col("page_number").alias("z_page"), "z_x", "z_y", "z_width", "z_height")

    changed = ["field_value", "confidence", "x", "y", "width", "height"]
    names = ["doc_id", "field_id", "field_name", "page_number", *changed]
    parts = 2 * int(fields.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a task sorts fields, hits and wanted labels
    rows = fields.select(*names, F.lit(True).alias("is_field")).unionByName(
        applied.select("doc_id", "template_id", F.lit(False).alias("is_field")), allowMissingColumns=True).repartition(parts, "doc_id")
    is_field = F.col("is_field")
    templates = F.collect_list("template_id").over(Window.partitionBy("doc_id"))  # null keys meet nothing
    rows = rows.withColumn("templates", F.when(is_field & F.col("doc_id").isNotNull(), templates)).select(
        "*", F.posexplode_outer("templates").alias("turn", "of_template")).drop("templates")
    rows = rows.withColumns({"cx": F.col("x") + F.col("width") / 2, "cy": F.col("y") + F.col("height") / 2, "page": page, "first": F.coalesce("turn", F.lit(0)) == 0})

    def cell_of(template, cell_page, level, gx, gy):
        return F.struct(template.alias("template_id"), cell_page.cast("long").alias("cell_page"), level.cast("int").alias("level"),
                        gx.cast("long").alias("gx"), gy.cast("long").alias("gy"))

    none = F.lit(None)
    itself = cell_of(F.col("of_template"), F.col("page"), none, none, none)
    placed = [cell_of(F.col("of_template"), F.col("page"), F.lit(n), F.floor(F.col("cx") / 2.0 ** n), F.floor(F.col("cy") / 2.0 ** n)) for n in levels]
    there = F.col("of_template").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull()
    cells = F.when(~is_field, F.array(cell_of(F.col("template_id"), F.lit(0), F.lit(ZONE_LIST), F.lit(0), F.lit(0)))) \
        .when(there & F.col("first"), F.array(itself, *placed)).when(there, F.array(*placed) if placed else none).when(F.col("first"), F.array(itself))
    rows = rows.select(*names, "page", F.explode(cells).alias("cell"), "cx", "cy")
    rows = rows.select("*", "cell.level").join(lookup, F.col("cell.level").isNotNull() & (F.col("cell.template_id") == F.col("z_template_id")) & (
        F.col("cell.cell_page") == F.col("z_cell_page")) & (F.col("cell.level") == F.col("z_level")) & (F.col("cell.gx") == F.col("z_gx")) & (
        F.col("cell.gy") == F.col("z_gy")), "left")
    old, want = F.col("level").isNull(), F.coalesce(F.col("level") == ZONE_LIST, F.lit(False))
    inside = F.col("cx").between(F.col("z_x"), F.col("z_x") + F.col("z_width")) & F.col("cy").between(F.col("z_y"), F.col("z_y") + F.col("z_height"))
    zone = F.struct(*[F.col(f"z_{c}").alias(c) for c in ("x", "y", "width", "height")])
    rows = rows.where(old | (want & F.col("z_page").isNotNull()) | inside).select(
        *names, F.when(old, "field").when(want, "wanted").otherwise("hit").alias("kind"), F.when(old, F.col("field_name")).otherwise(F.col("z_label")).alias("label"),
        F.when(old, F.col("page")).otherwise(F.col("z_page")).alias("page"), F.when(want, zone).alias("zone"))

    key = ["doc_id", "label", "page"]
    group, kind = Window.partitionBy(*key), F.col("kind")
    known = F.col("doc_id").isNotNull() & F.col("label").isNotNull()
    value = F.min_by(F.when(kind == "hit", F.struct("field_value", "confidence")), F.when(kind == "hit", F.col("field_id"))).over(group)
    rows = rows.select(
        "*", F.when(known, F.min(F.when(kind == "field", F.col("field_id"))).over(group)).alias("target"), F.when(known, value).alias("v"),
        F.collect_list("zone").over(group).alias("zones"))
    new = F.when(kind == "wanted", F.array("zone")).when((F.col("field_id") == F.col("target")) & (F.size("zones") > 0), F.col("zones"))
    rows = rows.where((kind == "field") | ((kind == "wanted") & F.col("target").isNull())).select("*", F.explode_outer(new).alias("n"))
    hit, added = F.col("n").isNotNull(), kind == "wanted"
    return rows.select(
        "doc_id", F.when(added, F.xxhash64("doc_id", "label", F.col("page").cast(page_type))).otherwise(F.col("field_id")).alias("field_id"),
        F.col("label").alias("field_name"), F.when(added, F.col("page")).otherwise(F.col("page_number")).alias("page_number"),
        *[F.when(hit, F.col(f"v.{c}")).otherwise(F.col(c)).alias(c) for c in changed[:2]], *[F.when(hit, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in changed[2:]],
        F.when(added, "added").when(hit, "updated").otherwise("kept").alias("change"))


# Line items out of named fields

ITEM_NAME = r"^item_(\d+)_(.+)$"


def line_item_rows(fields: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``item_<n>_<column>`` fields as rows; row confidence is the mean of the known cell confidences."""
    f = fields.select("*", F.regexp_extract("field_name", ITEM_NAME, 1).try_cast("int").alias("row_idx"),
                      F.regexp_extract("field_name", ITEM_NAME, 2).alias("column_name")).where(F.col("row_idx").isNotNull())

    def of(name, value):
        return F.max_by(F.when(F.col("column_name") == name, F.col(value)), F.when(F.col("column_name") == name, F.col("field_id")))

    agg = f.groupBy("doc_id", "row_idx").agg(
        *[of(c, "field_value").alias(c) for c in columns],
        *[of(c, "confidence").alias(f"__c_{c}") for c in columns])
    confs = [F.col(f"__c_{c}") for c in columns]
    known = sum((c.isNotNull().cast("int") for c in confs), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0)) for c in confs), F.lit(0)).cast("double")
    return agg.select("doc_id", "row_idx", *columns, F.try_divide(total, known).alias("row_confidence"))


def line_item_tables(rows: DataFrame) -> DataFrame:
    """Table confidence per document: mean of the known row confidences."""
    micro = F.round(F.col("row_confidence") * 1000000).cast("long")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("rows"), (F.sum(micro) / F.count(micro) / 1000000).alias("table_confidence"))

