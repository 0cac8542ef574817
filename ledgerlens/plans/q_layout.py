"""Tables, boxes, zones, matching and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import geometry as G
from ledgerlens.operators import layout as L
from ledgerlens.operators import matching as M
from ledgerlens.operators import search as S
from ledgerlens.plans.registry import query
from ledgerlens.sources import table_rows

# Rows: heights of a page, a step of 10 or more starts a new row.
ROWS = """y as (select distinct page_id, (y_min + y_max) / 2 as yc from ocr_boxes),
yl as (select *, case when yc - lag(yc) over (partition by page_id order by yc) >= 10 then 1 else 0 end as s from y),
yr as (select page_id, yc, cast(sum(s) over (partition by page_id order by yc) as integer) as row_idx from yl),
big as (select page_id, count(*) as cells, min(x_min) as rx_min, min(y_min) as ry_min, max(x_max) as rx_max, max(y_max) as ry_max from ocr_boxes group by page_id having count(*) >= 4),
bx as (select b.*, (b.x_min + b.x_max) / 2 as xc, yr.row_idx, (select max(row_idx) + 1 from yr z where z.page_id = b.page_id) as num_rows, big.rx_max
  from ocr_boxes b join big using (page_id) join yr on yr.page_id = b.page_id and yr.yc = (b.y_min + b.y_max) / 2)"""

MARKED = " or ".join(f"contains(lower(text), '{w}')" for w in L.HEADER_WORDS)
HEADER = ROWS + f""",
hr as (select page_id, row_idx, max(num_rows) as num_rows, (count(*) filter (where {MARKED})) / count(*) * 0.5::double
  + (1.0::double - row_idx / (max(num_rows) + 1)) * 0.3::double + case when sum(length(text)) / count(*) between 5 and 30 then 1.0::double else 0.6::double end * 0.2::double as score
  from bx where row_idx < 3 group by page_id, row_idx),
hd as (select page_id, case when num_rows < 2 then 0 else row_idx end as header_row, case when num_rows < 2 then 0.5 else least(1.0, score * 1.2::double) end::double as header_confidence
  from (select *, row_number() over (partition by page_id order by score desc, row_idx) as rn from hr) where rn = 1)"""


def standard_sql(col: str) -> str:
    cases = " ".join("when " + " or ".join(f"contains(lower({col}), '{w}')" for w in words) + f" then '{n}'" for n, words, _ in L.COLUMN_WORDS)
    return f"case {cases} else 'description' end"


def name_confidence_sql(col: str) -> str:
    cases = " ".join("when " + " or ".join(f"contains(lower({col}), '{w}')" for w in words) + f" then {c}" for n, words, c in L.COLUMN_WORDS)
    return f"(case {cases} else 0.6 end)::double"


COLUMNS = HEADER + f""",
cl as (select bx.page_id, row_number() over w - 1 as col_idx, text as detected_name, {standard_sql('text')} as standard_name, {name_confidence_sql('text')} as name_confidence,
  x_min as c_min, coalesce(lead(x_min) over w, rx_max) as c_max from bx join hd on hd.page_id = bx.page_id and bx.row_idx = hd.header_row
  window w as (partition by bx.page_id order by xc, box_id))"""

CELLS = COLUMNS + r""",
pl as (select * from (select bx.page_id, bx.row_idx, bx.box_id, bx.text, bx.x_min, bx.y_min, bx.x_max, bx.y_max, cl.col_idx, cl.standard_name,
    row_number() over (partition by bx.page_id, bx.box_id order by case when c_min <= xc and xc <= c_max then 0 else 1 end,
      case when c_min <= xc and xc <= c_max then 0 else abs(xc - (c_min + c_max) / 2) end, cl.col_idx) as rn
  from bx join hd on hd.page_id = bx.page_id and bx.row_idx <> hd.header_row join cl on cl.page_id = bx.page_id) where rn = 1),
ce as (select page_id, row_idx, col_idx, standard_name, text as value, min(x_min) over g as x_min, min(y_min) over g as y_min, max(x_max) over g as x_max, max(y_max) over g as y_max,
  row_number() over (partition by page_id, row_idx, col_idx order by length(text) desc, box_id) as r2 from pl window g as (partition by page_id, row_idx, col_idx)),
cells as (select * exclude (r2), standard_name not in ('quantity', 'unit_price', 'amount') or regexp_matches(value, '\d') as is_valid,
  case when standard_name in ('quantity', 'unit_price', 'amount') then case when regexp_matches(value, '\d') then 0.95 else 0.1 end else 0.9 end::double as confidence from ce where r2 = 1)"""


@query("W7", views="ocr_boxes", sql="with " + ROWS + " select b.page_id, b.box_id, yr.row_idx from ocr_boxes b join yr on yr.page_id = b.page_id and yr.yc = (b.y_min + b.y_max) / 2")
def row_islands(t):
    return L.row_islands(t.ocr_boxes).select("page_id", "box_id", "row_idx")


@query("A25", views="ocr_boxes", sql="with " + ROWS + " select * from big")
def table_regions(t):
    return L.regions(t.ocr_boxes)


@query("A25", views="ocr_boxes", sql="with " + ROWS + """
select page_id, row_idx, min(x_min) as x_min, min(y_min) as y_min, max(x_max) as x_max, max(y_max) as y_max, count(*) as cells from bx group by page_id, row_idx""")
def table_row_boxes(t):
    return L.row_boxes(L.with_rows(t.ocr_boxes))


@query("X17", views="ocr_boxes", sql="with " + HEADER + " select page_id, header_row, header_confidence from hd")
def header_row_detection(t):
    return L.header_rows(t.ocr_boxes)


@query("W6 X18", views="ocr_boxes", sql="with " + COLUMNS + " select * from cl")
def header_columns(t):
    return L.header_columns(L.with_rows(t.ocr_boxes))


@query("J10 X21 X22 H8", views="ocr_boxes", sql="with " + CELLS + " select page_id, row_idx, col_idx, standard_name, value, is_valid, confidence, x_min, y_max from cells")
def table_cells(t):
    return L.table_cells(t.ocr_boxes).select("page_id", "row_idx", "col_idx", "standard_name", "value", "is_valid", "confidence", "x_min", "y_max")


TABLES = CELLS + """,
rc as (select page_id, row_idx, count(*) as cells, cast(sum(cast(round(confidence * 100) as bigint)) as bigint) / count(*) / 100 as row_confidence from cells group by page_id, row_idx),
tb as (select page_id, count(*) as rows, cast(sum(cells) as bigint) as cells, cast(sum(cast(round(row_confidence * 1000000) as bigint)) as bigint) / count(*) / 1000000 as overall_confidence from rc group by page_id),
tables as (select p.page_id, tb.page_id is not null as table_found, coalesce(rows, 0) as rows, coalesce(cells, 0) as cells, coalesce(overall_confidence, 0.0) as overall_confidence,
  least(1.0, coalesce(rows, 0) / 10)::double as table_confidence from (select distinct page_id from ocr_boxes) p left join tb on tb.page_id = p.page_id)"""


@query("X22 A20", views="ocr_boxes", sql="with " + TABLES + " select * from tables")
def extracted_tables(t):
    return L.extracted_tables(t.ocr_boxes)


@query("A16", views="ocr_boxes", sql="with " + TABLES + """
select count(*) as documents, count(*) filter (where table_found) as tables_found, (count(*) filter (where table_found)) / count(*) as detection_rate,
  cast(sum(rows) as bigint) as rows, cast(sum(cells) as bigint) as cells from tables""")
def table_statistics(t):
    return L.table_statistics(L.extracted_tables(t.ocr_boxes))


@query("A16", views="ocr_boxes", sql="with " + TABLES + """
select standard_name, count(*) as total_extracted, cast(sum(cast(round(confidence * 100) as bigint)) as bigint) / count(*) / 100 as avg_confidence,
  (select count(*) from rc) as total_rows, count(*) / (select count(*) from rc) as detection_rate from cells group by standard_name""")
def column_statistics(t):
    return L.column_statistics(L.table_cells(t.ocr_boxes))


GAP = "least(abs(a.{0}_min - b.{0}_max), abs(b.{0}_min - a.{0}_max), abs((a.{0}_min + a.{0}_max) / 2 - (b.{0}_min + b.{0}_max) / 2))"


@query("J12", views="ocr_boxes", sql=f"""
select a.page_id, a.box_id, count(b.box_id) as neighbours from ocr_boxes a left join ocr_boxes b on a.page_id = b.page_id and a.box_id <> b.box_id
  and {GAP.format('x')} < 50 and {GAP.format('y')} < 50 group by a.page_id, a.box_id""")
def box_neighbours(t):
    return L.neighbour_counts(t.ocr_boxes)


@query("X16 H7", views="ocr_boxes", sql="""
with l as (select *, line_no - lag(line_no) over (partition by page_id order by line_no) > 2 as cut from (select distinct page_id, line_no from ocr_boxes)),
g as (select *, count(*) filter (where cut) over (partition by page_id order by line_no) as island from l)
select b.page_id, b.box_id, cast(min(b.box_id) over (partition by b.page_id, g.island) as bigint) as cluster_id from ocr_boxes b join g on g.page_id = b.page_id and g.line_no = b.line_no""")
def box_clusters(t):
    return L.cluster_boxes(t.ocr_boxes)


@query("X19 X47", views="ocr_boxes", sql="""
select page_id, box_id, (x_min + x_max) / 2 as cx, x_max - x_min as width, least(x_max, 160) - greatest(x_min, 60) > 0.5::double * least(x_max - x_min, 100) as on_x,
  least(y_max, 100) - greatest(y_min, 35) > 0.5::double * least(y_max - y_min, 65) as on_y, x_min as qx, y_max - y_min as qh from ocr_boxes""")
def box_geometry(t):
    c = F.col
    quad = F.array(F.array("x_min", "y_min"), F.array("x_max", "y_min"), F.array("x_max", "y_max"), F.array("x_min", "y_max"))
    return t.ocr_boxes.select(
        "page_id", "box_id", G.center(c("x_min"), c("x_max")).alias("cx"),
        G.ltrb_to_xywh(c("x_min"), c("y_min"), c("x_max"), c("y_max"))["width"].alias("width"),
        G.overlaps(c("x_min"), c("x_max"), F.lit(60.0), F.lit(160.0)).alias("on_x"), G.overlaps(c("y_min"), c("y_max"), F.lit(35.0), F.lit(100.0)).alias("on_y"),
        G.quad_to_xywh(quad)["x"].alias("qx"), G.quad_to_xywh(quad)["height"].alias("qh"))


# Two orders side by side on a page: several tables that share heights. A cluster is named by its first box; its key is a text here.
PAIRED = """pb as (select b.page_id // 2 as page_id, b.page_id % 2 * 1000 + b.box_id as box_id, b.x_min + b.page_id % 2 * 400 as x_min, b.x_max + b.page_id % 2 * 400 as x_max,
  y_min, y_max, text, line_no, b.page_id % 2 as side from ocr_boxes b),
pl0 as (select *, line_no - lag(line_no) over (partition by page_id, side order by line_no) > 2 as cut from (select distinct page_id, side, line_no from pb)),
pi as (select *, count(*) filter (where cut) over (partition by page_id, side order by line_no) as island from pl0),
pc as (select pb.* exclude (page_id), concat(pb.page_id, ':', min(box_id) over (partition by pb.page_id, pb.side, island)) as page_id
  from pb join pi on pi.page_id = pb.page_id and pi.side = pb.side and pi.line_no = pb.line_no)"""
SPLIT = "cast(split_part({0}page_id, ':', 1) as bigint) as page_id, cast(split_part({0}page_id, ':', 2) as bigint) as cluster_id"
CLUSTER_TABLES = PAIRED + ", " + TABLES.replace("ocr_boxes", "pc")


def paired_boxes(t):
    side = F.col("page_id") % 2
    return t.ocr_boxes.select(
        F.floor(F.col("page_id") / 2).alias("page_id"), (side * 1000 + F.col("box_id")).alias("box_id"), "text", (F.col("x_min") + side * 400).alias("x_min"),
        (F.col("x_max") + side * 400).alias("x_max"), "y_min", "y_max")


@query("J10 X22 A25", views="ocr_boxes", sql="with " + CLUSTER_TABLES + f" select {SPLIT.format('')}, row_idx, col_idx, standard_name, value, is_valid, confidence, x_min, y_max from cells")
def cluster_table_cells(t):
    """Cells of all tables of pages that hold several."""
    return L.page_tables(paired_boxes(t)).cells.select(
        *L.TABLE, "row_idx", "col_idx", "standard_name", "value", "is_valid", "confidence", "x_min", "y_max")


@query("X22 A20 A25 X17", views="ocr_boxes", sql="with " + CLUSTER_TABLES + f""",
nc as (select page_id, count(*) as columns from cl group by page_id)
select {SPLIT.format('big.')}, rx_min, ry_min, big.rx_max, ry_max, cast(header_row as integer) as header_row, header_confidence, columns, coalesce(tables.rows, 0) as rows, coalesce(tables.cells, 0) as cells,
  overall_confidence, table_confidence from big join hd using (page_id) join nc using (page_id) join tables using (page_id)""")
def cluster_tables(t):
    """One row per table: region, header, sizes, confidences."""
    return L.page_tables(paired_boxes(t)).tables


@query("A16", views="ocr_boxes", sql="with " + CLUSTER_TABLES + """,
po as (select standard_name, cast(sum(tables.rows) as bigint) as possible from cl join tables using (page_id) group by standard_name),
la as (select standard_name, max_by(confidence, col_idx) as c from cells group by page_id, row_idx, standard_name),
ex as (select standard_name, count(*) as extracted, cast(sum(cast(round(c * 100) as bigint)) as bigint) / count(*) / 100 as avg_confidence from la group by standard_name)
select standard_name, possible, coalesce(extracted, 0) as extracted, coalesce(avg_confidence, 0.0) as avg_confidence, case when possible > 0 then coalesce(extracted, 0) / possible else 0.0 end as detection_rate
from po left join ex using (standard_name)""")
def column_detection(t):
    """Rates over the rows that have the column in their header."""
    return L.column_detection(L.page_tables(paired_boxes(t)))


@query("A16", views="ocr_boxes item_fields", sql="with " + CELLS + """,
v as (select standard_name, 'alignment' as method, confidence from cells union all select regexp_extract(field_name, '_([a-z]+)$', 1), 'named_field', cast(confidence as double) from item_fields)
select standard_name, method, count(*) as total_extracted, cast(sum(cast(round(confidence * 100) as bigint)) as bigint) / count(confidence) / 100 as avg_confidence from v group by all""")
def column_methods(t):
    """Counts and mean confidence by the way a value was found: in a table of boxes, or as a named field."""
    aligned = L.table_cells(t.ocr_boxes).select("standard_name", F.lit("alignment").alias("method"), "confidence")
    named = t.item_fields.select(
        F.regexp_extract("field_name", "_([a-z]+)$", 1).alias("standard_name"), F.lit("named_field").alias("method"), F.col("confidence").cast("double"))
    return L.method_statistics(aligned.unionByName(named))


@query("H8", views="ocr_boxes", sql="with " + CELLS + """
select page_id, page_id as cluster_id, cast(row_idx as integer) as row_idx, row_confidence, last.standard_name, last.value from (
  select page_id, row_idx, standard_name, max_by(value, col_idx) as value from cells group by all) last
join (select page_id, row_idx, cast(sum(cast(round(confidence * 100) as bigint)) as bigint) / count(*) / 100 as row_confidence from cells group by all) using (page_id, row_idx)""")
def table_rows_function(t):
    """The table function of SQL over the cells, its rows laid out again."""
    table_rows.register(t.spark)
    cells = L.table_cells(t.ocr_boxes).withColumn("cluster_id", F.col("page_id"))
    rows = t.spark.sql(
        "select * from table_rows(table(select page_id, cluster_id, row_idx, col_idx, standard_name, value, confidence from {cells}) "
        "partition by (page_id, cluster_id) order by (row_idx, col_idx))", cells=cells)
    return rows.select("page_id", "cluster_id", "row_idx", "row_confidence", F.explode("cells").alias("standard_name", "value"))


LABELS = {"quantity": ["qty"], "total_amount": ["amount"], "invoice_number": ["item", "part 1"]}
LABEL_ROWS = ", ".join(f"('{f}', '{w}')" for f, ws in LABELS.items() for w in ws)


@query("J11", views="ocr_boxes", sql=f"""
with b as (select page_id, box_id, lower(text) as text, (x_min + x_max) / 2 as cx, (y_min + y_max) / 2 as cy from ocr_boxes),
l as (select distinct page_id, box_id, field_name, cx, cy from b join (values {LABEL_ROWS}) k(field_name, word) on contains(b.text, k.word)),
p as (select l.page_id, l.field_name, l.box_id as label_id, b.box_id as value_id, b.text as value,
  case when abs(b.cy - l.cy) < 20 and b.cx - l.cx > 0 and b.cx - l.cx < 300 then b.cx - l.cx else b.cy - l.cy end as dist,
  case when abs(b.cy - l.cy) < 20 and b.cx - l.cx > 0 and b.cx - l.cx < 300 then 1.0 else 0.8 end::double as weight
  from l join b on b.page_id = l.page_id and b.box_id <> l.box_id
  where ((abs(b.cy - l.cy) < 20 and b.cx - l.cx > 0 and b.cx - l.cx < 300) or (abs(b.cx - l.cx) < 50 and b.cy - l.cy > 0 and b.cy - l.cy < 100))
    and case l.field_name when 'total_amount' then regexp_matches(b.text, '\\d') when 'invoice_number' then length(b.text) > 2 else true end)
select page_id, field_name, label_id, value_id, value, dist, weight * (1.0::double - dist / 500) as score
from (select *, row_number() over (partition by page_id, field_name, label_id order by dist, value_id) as rn from p) where rn = 1""")
def values_near_labels(t):
    return L.values_near_labels(t.ocr_boxes, LABELS)


ZONES = [("first_item", 1, 0.0, 35.0, 85.0, 40.0), ("total_amount", 1, 150.0, 60.0, 100.0, 60.0), ("note", 2, 0.0, 0.0, 50.0, 50.0)]
ZONE_ROWS = ", ".join(f"('{z[0]}', {z[1]}, {z[2]}, {z[3]}, {z[4]}, {z[5]})" for z in ZONES)


@query("J9", views="ocr_boxes", sql=f"""
with z as (select * from (values {ZONE_ROWS}) z(label, zone_page, zx, zy, zw, zh)),
f as (select page_id as doc_id, box_id as field_id, case when col_idx = 2 then 'total_amount' else 'text' end as field_name, text as field_value, 1 as page_number, x_min + 35 as cx, y_min + 10 as cy from ocr_boxes),
h as (select doc_id, label, zone_page, min_by(field_value, field_id) as value from f join z on page_number = zone_page and cx between zx and zx + zw and cy between zy and zy + zh group by all)
select d.doc_id, z.label, z.zone_page, h.value, exists (select 1 from f where f.doc_id = d.doc_id and f.field_name = z.label and z.zone_page = 1) as replaces_field
from (select distinct doc_id from f) d cross join z left join h on h.doc_id = d.doc_id and h.label = z.label and h.zone_page = z.zone_page""")
def template_zones(t):
    return L.apply_zones(boxes_as_fields(t), ZONES).drop("confidence")


ZONE_TABLE = """z as (select i // 10 as template_id, i % 10 as sort_order, case i % 5 when 0 then 'total_amount' else concat('zone_', cast(i % 5 as varchar)) end as label,
  cast(i % 3 // 2 + 1 as integer) as page_number, cast(i % 7 * 30 as double) as x, cast(i % 11 * 20 as double) as y, cast(20 + i % 4 * 200 as double) as width, cast(15 + i % 6 * 40 as double) as height
  from range(10000) r(i))"""


def boxes_as_fields(t):
    return t.ocr_boxes.select(
        F.col("page_id").alias("doc_id"), F.col("box_id").alias("field_id"), F.when(F.col("col_idx") == 2, "total_amount").otherwise("text").alias("field_name"),
        F.col("text").alias("field_value"), F.lit(0.5).alias("confidence"), F.lit(None).cast("int").alias("page_number"), F.col("x_min").alias("x"),
        F.col("y_min").alias("y"), (F.col("x_max") - F.col("x_min")).alias("width"), (F.col("y_max") - F.col("y_min")).alias("height"))


@query("J9", views="ocr_boxes", sql=f"""
with {ZONE_TABLE},
zz as (select * from z qualify row_number() over (partition by template_id, label, page_number order by sort_order desc) = 1),
f as (select page_id as doc_id, box_id as field_id, case when col_idx = 2 then 'total_amount' else 'text' end as field_name, text as field_value, 0.5::double as confidence,
  x_min as x, y_min as y, x_max - x_min as width, y_max - y_min as height from ocr_boxes),
want as (select d.doc_id, zz.* from (select distinct doc_id from f) d join zz on zz.template_id = d.doc_id % 1000),
h as (select w.doc_id, w.label, w.page_number, min_by(f.field_value, f.field_id) as v from want w join f on f.doc_id = w.doc_id and w.page_number = 1
  and f.x + f.width / 2 between w.x and w.x + w.width and f.y + f.height / 2 between w.y and w.y + w.height group by all),
g as (select doc_id, field_name as label, 1 as page_number, min(field_id) as target from f group by all),
s as (select w.*, h.v, g.target from want w left join h using (doc_id, label, page_number) left join g using (doc_id, label, page_number)),
u as (select f.doc_id, f.field_id, f.field_name, case when s.target is not null then s.v else f.field_value end as field_value, case when s.target is not null then s.x else f.x end as x,
  case when s.target is not null then 'updated' else 'kept' end as change from f left join s on s.doc_id = f.doc_id and s.target = f.field_id
  union all select doc_id, null, label, v, x, 'added' from s where target is null)
select doc_id, field_id, field_name, field_value, x, change from u""")
def template_upsert(t):
    """The field table after 10,000 zones of 1,000 templates were applied to the documents."""
    i = F.col("id")
    zones = t.spark.range(10000).select(
        F.floor(i / 10).alias("template_id"), (i % 10).alias("sort_order"), F.when(i % 5 == 0, "total_amount").otherwise(F.concat(F.lit("zone_"), (i % 5).cast("string"))).alias("label"),
        (F.floor(i % 3 / 2) + 1).cast("int").alias("page_number"), (i % 7 * 30).cast("double").alias("x"), (i % 11 * 20).cast("double").alias("y"),
        (20 + i % 4 * 200).cast("double").alias("width"), (15 + i % 6 * 40).cast("double").alias("height"))
    fields = boxes_as_fields(t)
    applied = fields.select("doc_id", (F.col("doc_id") % 1000).alias("template_id")).distinct()
    out = L.zone_upsert(fields, zones, applied)
    return out.select("doc_id", F.when(F.col("change") != "added", F.col("field_id")).alias("field_id"), "field_name", "field_value", "x", "change")


@query("A23", views="item_fields", sql="""
select doc_id, row_idx, max(case when c = 'description' then field_value end) as description, max(case when c = 'quantity' then field_value end) as quantity,
  max(case when c = 'amount' then field_value end) as amount, cast(sum(confidence) as double) / count(confidence) as row_confidence
from (select *, cast(regexp_extract(field_name, '_([0-9]+)_', 1) as int) as row_idx, regexp_extract(field_name, '_([a-z]+)$', 1) as c from item_fields) group by doc_id, row_idx""")
def line_item_rows(t):
    return L.line_item_rows(t.item_fields, ["description", "quantity", "amount"])


@query("A23", views="item_fields", sql="""
select doc_id, count(*) as rows, cast(sum(cast(round(rc * 1000000) as bigint)) as bigint) / count(*) / 1000000 as table_confidence from (
  select doc_id, cast(sum(confidence) as double) / count(confidence) as rc from (select *, cast(regexp_extract(field_name, '_([0-9]+)_', 1) as int) as row_idx from item_fields) group by doc_id, row_idx) group by doc_id""")
def line_item_tables(t):
    return L.line_item_tables(L.line_item_rows(t.item_fields, ["description", "quantity", "amount"]))


# Matching

SAME_NUMBER = M.MatchRule(1, [("invoice_number", "equals", "Invoice_Number")], updated_at="2024-01-01")
SAME_VENDOR = M.MatchRule(2, [("vendor_name", "equals", "vendor_name")], ["receipt", " Invoice "], updated_at="2024-02-01")
BIGGER = M.MatchRule(3, [("invoice_number", "equals", "invoice_number"), ("total_amount", "greater_than", "total_amount"),
                         ("vendor_name", "starts_with", "vendor_name")], updated_at="2024-03-01")
LARGER = M.MatchRule(4, [("invoice_number", "equals", "invoice_number"), ("total_amount", "greater_than", "total_amount")], updated_at="2024-03-01")


@query("J5 J6", views="invoice_docs", sql="""
select concat('inv-', cast(doc_id - doc_id % 3 as varchar)) as f_0, count(*) as documents, min(doc_id) as first_id, max(doc_id) as last_id, (count(*) * (count(*) - 1) / 2)::double as pairs
from invoice_docs group by doc_id - doc_id % 3 having count(*) > 1""")
def match_groups(t):
    return M.match_groups(t.invoice_docs, t.extracted_fields, SAME_NUMBER)


@query("J5", views="invoice_docs", sql="""
select a.doc_id as left_id, b.doc_id as right_id, a.name as left_name, b.name as right_name from invoice_docs a
join invoice_docs b on a.doc_id - a.doc_id % 3 = b.doc_id - b.doc_id % 3 and (a.created_at, a.doc_id) < (b.created_at, b.doc_id) and a.total_amount > b.total_amount""")
def rule_pairs(t):
    return M.rule_pairs(t.invoice_docs, t.extracted_fields, LARGER).select("left_id", "right_id", "left_name", "right_name")


PREFIXED = M.MatchRule(7, [("invoice_number", "starts_with", "short_number")])


@query("J5", views="extracted_fields invoice_docs", sql="""
with f as (select doc_id, field_value as v, doc_id % 50 = 1 as has, substr(field_value, 1, 5) as short from extracted_fields where field_name = 'invoice_number')
select a.doc_id as left_id, b.doc_id as right_id from invoice_docs a join f x on x.doc_id = a.doc_id, invoice_docs b join f y on y.doc_id = b.doc_id
where (a.created_at, a.doc_id) < (b.created_at, b.doc_id) and y.has and starts_with(lower(x.v), lower(y.short))""")
def prefix_pairs(t):
    """A rule of ``starts_with`` alone: numbers that begin with another document's short number, which every fiftieth document has."""
    f = t.extracted_fields.where("field_name = 'invoice_number'")
    short = f.where("doc_id % 50 = 1").withColumns({"field_name": F.lit("short_number"), "field_value": F.substring("field_value", 1, 5)})
    with_short = f.join(short.select("doc_id"), "doc_id", "left_semi")
    absent = f.join(with_short.select("doc_id"), "doc_id", "left_anti").withColumns({"field_name": F.lit("short_number"), "field_value": F.lit("none of these")})
    return M.rule_pairs(t.invoice_docs, f.union(short.select(f.columns)).union(absent), PREFIXED).select("left_id", "right_id")


MORE = M.MatchRule(8, [("total_amount", "greater_than", "total_amount")], ["Receipt", " invoice "])


@query("J6", views="extracted_fields invoice_docs", sql="""
with c as (select d.doc_id, d.created_at, try_cast(replace(trim(field_value), ',', '') as decimal(28,6)) as v from invoice_docs d join extracted_fields f on f.doc_id = d.doc_id and f.field_name = 'total_amount'
  where type in ('receipt', 'invoice'))
select (select (count(*) * (count(*) - 1) / 2)::bigint from invoice_docs where type in ('receipt', 'invoice')) as evaluated_pairs,
  (select count(*) from c a join c b on a.v > b.v and (a.created_at, a.doc_id) < (b.created_at, b.doc_id)) as matched_pairs""")
def rule_preview_inequality(t):
    """Counts of a rule with nothing but an inequality."""
    matched = M.inequality_pairs(t.invoice_docs, t.extracted_fields, MORE)
    return M.preview_counts(t.invoice_docs, MORE, matched).drop("skipped_pairs")


OPERATORS = ["equals", "contains", "starts_with", "greater_than", "less_than", "unknown"]


@query("J5", views="extracted_fields", sql=r"""
with p as (select lower(trim(coalesce(a.field_value, ''))) as x, lower(trim(coalesce(case when a.doc_id % 5 = 0 then '' when a.doc_id % 5 = 1 then substr(a.field_value, 1, 4) when a.doc_id % 5 = 2 then upper(a.field_value) else substr(a.field_value, 3) end, ''))) as y from extracted_fields a)
select count(*) filter (where x <> '' and x = y) as equals, count(*) filter (where x <> '' and contains(x, y)) as contains, count(*) filter (where x <> '' and starts_with(x, y)) as starts_with,
  count(*) filter (where try_cast(x as decimal(28,6)) > try_cast(y as decimal(28,6))) as greater_than, count(*) filter (where try_cast(x as decimal(28,6)) < try_cast(y as decimal(28,6))) as less_than, cast(0 as bigint) as unknown from p""")
def rule_operators(t):
    """Every operator of a rule over the fields and an altered copy of each value."""
    v, d = F.col("field_value"), F.col("doc_id")
    other = F.when(d % 5 == 0, "").when(d % 5 == 1, F.substring(v, 1, 4)).when(d % 5 == 2, F.upper(v)).otherwise(F.substr(v, F.lit(3)))
    a, b = F.lower(F.trim(v)), F.lower(F.trim(other))
    return t.extracted_fields.agg(*[F.count_if(M.holds(a, op, b)).alias(op) for op in OPERATORS])


@query("J6", views="invoice_docs", sql="""
select (m * (m - 1) / 2)::bigint as evaluated_pairs, ((n * (n - 1) - m * (m - 1)) / 2)::bigint as skipped_pairs, mp as matched_pairs from (
  select count(*) as n, count(*) filter (where type in ('receipt', 'invoice')) as m from invoice_docs),
  (select (sum(k * (k - 1)) / 2)::bigint as mp from (select count(*) as k from invoice_docs where type in ('receipt', 'invoice') group by vendor_name))""")
def rule_preview(t):
    groups = M.match_groups(t.invoice_docs, t.extracted_fields, SAME_VENDOR)
    return M.preview_counts(t.invoice_docs, SAME_VENDOR, groups.agg(F.sum("pairs").cast("long")))


FREE = "free as (select * from invoice_docs where doc_id not in (select document_id from match_links))"


@query("J7", views="invoice_docs match_links", sql=f"""with {FREE},
v as (select *, (row_number() over (partition by vendor_name order by created_at, doc_id) - 1) // 2 as pn from free where type in ('receipt', 'invoice')),
p1 as (select 2 as rule_id, min_by(doc_id, (created_at, doc_id)) as left_id, max_by(doc_id, (created_at, doc_id)) as right_id from v group by vendor_name, pn having count(*) = 2),
rest as (select * from free where doc_id not in (select left_id from p1) and doc_id not in (select right_id from p1)),
i as (select *, (row_number() over (partition by doc_id - doc_id % 3 order by created_at, doc_id) - 1) // 2 as pn from rest)
select * from p1 union all
select 1, min_by(doc_id, (created_at, doc_id)), max_by(doc_id, (created_at, doc_id)) from i group by doc_id - doc_id % 3, pn having count(*) = 2""")
def auto_match(t):
    return M.auto_match(t.invoice_docs, t.extracted_fields, t.match_links, [SAME_NUMBER, SAME_VENDOR])


@query("J7", views="invoice_docs match_links", sql=f"""with {FREE},
p as (select a.doc_id - a.doc_id % 3 as k, a.doc_id as left_id, b.doc_id as right_id, a.created_at as la, b.created_at as ra, a.name as ln, b.name as rn from free a
  join free b on a.doc_id - a.doc_id % 3 = b.doc_id - b.doc_id % 3 and (a.created_at, a.doc_id) < (b.created_at, b.doc_id) and a.total_amount > b.total_amount)
select left_id as set_id, 4 as rule_id, concat('Auto Match ', ln, ' + ', rn) as name, 'review' as status, 'auto' as source, left_id, right_id
from (select *, row_number() over (partition by k order by la, left_id, ra, right_id) as first from p) where first = 1""")
def auto_match_general(t):
    """A rule with an inequality: at most three documents share a number, so the first edge per number wins."""
    pairs = M.auto_match(t.invoice_docs, t.extracted_fields, t.match_links, [LARGER])
    return M.match_set_rows(pairs, t.invoice_docs)


# Search

QUERY = "(select embedding::double[] from embeddings order by vec_id limit 1)"


@query("L4 X49", sql=f"""
with s as (select vec_id, list_cosine_similarity(embedding::double[], {QUERY}) as score from embeddings)
select vec_id, cast(round(score * 1000000) as bigint) as micro_score from s where score is not null order by score desc, vec_id limit 10""")
def semantic_search(t):
    query = t.embeddings.agg(F.min_by("embedding", "vec_id")).scalar()
    r = S.semantic_search(t.embeddings.withColumn("wanted", query), F.col("wanted"), 10)
    return r.select("vec_id", F.round(F.col("score") * 1000000).cast("long").alias("micro_score"))


AXES = {"low": [1.0 if i < 32 else 0.0 for i in range(64)], "alternating": [1.0 if i % 2 == 0 else -1.0 for i in range(64)]}


@query("L4 X49", sql="""
with q as (select 'low' as query, list_transform(range(64), lambda i: case when i < 32 then 1.0 else 0.0 end)::double[] as v
  union all select 'alternating', list_transform(range(64), lambda i: case when i % 2 = 0 then 1.0 else -1.0 end)::double[]),
s as (select query, vec_id, list_cosine_similarity(embedding::double[], v) as score from embeddings cross join q)
select query, vec_id, rank from (select *, row_number() over (partition by query order by score desc, vec_id) as rank from s where score is not null) where rank <= 5""")
def semantic_search_batch(t):
    return S.semantic_search_batch(t.embeddings, AXES, 5).select("query", "vec_id", "rank")


TOKENS = r"regexp_extract_all(lower(text), '[\pL\pN]+')"


@query("L5 X20", sql=f"""
with d as (select doc_id, {TOKENS} as toks from documents)
select doc_id, len(list_filter(toks, lambda x: x in ('the', 'and', 'of'))) / len(toks) as rank from d
where list_contains(toks, 'the') and list_contains(toks, 'and') and list_contains(toks, 'of') order by rank desc, doc_id limit 50""")
def ranked_text_search(t):
    return S.search_ranked(t.documents, "the and of", 50).select("doc_id", "rank")


@query("X20", sql=f"""
with d as (select doc_id, source, {TOKENS.replace('lower(text)', "lower(concat_ws(' ', text, source))")} as toks from documents)
select doc_id, len(list_filter(toks, lambda x: x in ('src1'))) / len(toks) as rank from d where list_contains(toks, 'src1') or contains(lower(source), 'src1')""")
def text_search_by_name(t):
    return S.search_text(t.documents, "Src1", name="source").select("doc_id", "rank")


@query("X9", sql="select doc_id, source from documents where contains(lower(text), 'the of') or contains(lower(source), 'the of')")
def substring_search(t):
    return S.search_simple(t.documents, "The of", ["text", "source"]).select("doc_id", "source")
