"""Document-store tables derived from the benchmark tables.

Each derived table exists twice: as a DataFrame (property of ``Tables``) and as a SQL view text
(``VIEWS``) for the check engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.jobs import STEPS

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Tables:
    """Lazy access to base and derived tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    @cached_property
    def invoice_docs(self) -> DataFrame:
        money = "decimal(18,2)"
        price = F.col("l_extendedprice").cast(money)
        sums = self.lineitem.groupBy("l_orderkey").agg(
            F.sum(price).cast(money).alias("subtotal"),
            F.sum(price * F.col("l_tax").cast("decimal(4,2)")).cast(money).alias("vat"),
            F.count("*").alias("line_count"),
        )
        k = F.col("o_orderkey")
        extra = F.when(k % 10 == 0, F.lit(7)).otherwise(F.lit(0))
        return (
            self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(sums, k == F.col("l_orderkey"))  # last, so the rows lie by document
            .select(
                k.alias("doc_id"),
                F.col("o_custkey").alias("user_id"),
                F.concat(F.lit("DOC-"), k.cast("string")).alias("name"),
                F.when(k % 4 == 0, "invoice").when(k % 4 == 1, "receipt")
                .when(k % 4 == 2, "purchase_order").otherwise("tax_invoice").alias("type"),
                F.when(F.col("o_orderstatus") == "F", "completed")
                .when(F.col("o_orderstatus") == "O", "processing").otherwise("needs_review").alias("status"),
                F.when(k % 17 != 0, F.col("c_nationkey").cast("long")).alias("category_id"),
                F.col("o_orderpriority").alias("priority"),
                (((k * 37) % 101) * F.expr("0.01")).cast("decimal(5,4)").alias("confidence"),
                F.col("o_orderdate").alias("created_at"),
                F.col("c_name").alias("vendor_name"),
                "subtotal", "vat",
                (F.col("subtotal") + F.col("vat") + extra).cast(money).alias("total_amount"),
                "line_count",
            )
        )

    @cached_property
    def extracted_fields(self) -> DataFrame:
        """Five fields per document. Columns are chosen by number, so what a query does not read is not computed or shuffled below."""
        d, n = F.col("doc_id"), F.col("n")
        pct = F.expr("0.01")
        slots = [
            ("invoice_number", F.concat(F.lit("INV-"), (d - d % 3).cast("string")), F.lit(95), d % 11 == 0),
            ("subtotal", F.col("subtotal"), (d * 13) % 101, d % 7 == 0),
            ("vat", F.col("vat"), (d * 17) % 101, d % 5 == 0),
            ("total_amount", F.col("total_amount"), (d * 19) % 101, d % 3 == 0),
            ("vendor_name", F.col("vendor_name"), F.lit(90), F.lit(False)),
        ]

        def chosen(values):
            *head, last = values
            out = F
            for i, v in enumerate(head, 1):
                out = out.when(n == i, v)
            return out.otherwise(last)

        numbers = F.explode(F.array(*[F.lit(i) for i in range(1, len(slots) + 1)])).alias("n")
        return self.invoice_docs.select("doc_id", "created_at", "subtotal", "vat", "total_amount", "vendor_name", numbers).select(
            "doc_id", "created_at", (d * 10 + n).alias("field_id"), (n % 2 + 1).alias("page_number"),
            chosen([F.lit(s[0]) for s in slots]).alias("field_name"), chosen([s[1].cast("string") for s in slots]).alias("field_value"),
            chosen([(s[2] * pct).cast("decimal(5,4)") for s in slots]).alias("confidence"), chosen([s[3] for s in slots]).alias("is_corrected"),
            (d % 6 == n).alias("is_edited"))

    @cached_property
    def sparse_fields(self) -> DataFrame:
        """The extracted fields as an extraction leaves them that did not find all: gaps where the full table has corrections."""
        return self.extracted_fields.where(~F.col("is_corrected"))

    @cached_property
    def field_corrections(self) -> DataFrame:
        e = F.col("event_id")
        fields = self.extracted_fields.select("field_id", "field_value")
        events = self.events.withColumn("fid", (F.floor(e / 12)) * 10 + 1 + e % 5)
        return events.join(fields, F.col("fid") == F.col("field_id")).select(
            e.alias("correction_id"), "field_id", "user_id", F.col("ts").alias("corrected_at"),
            F.col("field_value").alias("original_value"),
            F.when(e % 13 != 0, F.concat("field_value", F.lit("*"))).alias("corrected_value"),
            F.when(F.col("event_type") == "click", "ocr_error").when(F.col("event_type") == "view", "extraction_error")
            .when(F.col("event_type") == "purchase", "format_error").when(F.col("event_type") == "signup", "missing")
            .otherwise("other").alias("correction_reason"),
            F.when(e % 5 == 0, "excellent").when(e % 5 == 1, "good").when(e % 5 == 2, "poor")
            .when(e % 5 == 3, "unusable").alias("feedback_sentiment"),
            (F.col("value") > 200).alias("is_critical"),
            ((e % 41 - 20) * F.expr("0.01")).cast("decimal(5,4)").alias("confidence_adjustment"),
        )

    @cached_property
    def ocr_boxes(self) -> DataFrame:
        """Three boxes per line item and a header row per order; one line per (order, number)."""
        money = "decimal(18,2)"
        lines = self.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
            F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")).alias("m")
        )
        n = F.col("l_linenumber")

        def box(idx, x, y, text):
            return F.struct(
                F.lit(idx).alias("col_idx"), F.lit(float(x)).alias("x_min"), F.lit(float(x + 70)).alias("x_max"),
                y.cast("double").alias("y_min"), (y + 20).cast("double").alias("y_max"), text.alias("text"),
            )

        body = lines.select(
            F.col("l_orderkey").alias("page_id"), n.alias("line_no"),
            F.inline(F.array(
                box(0, 10, 30 * n + 10, F.concat(F.lit("Part "), F.col("m.l_partkey").cast("string"))),
                box(1, 90, 30 * n + 10, F.col("m.l_quantity").cast(money).cast("string")),
                box(2, 160, 30 * n + 10, F.col("m.l_extendedprice").cast(money).cast("string")),
            )),
        )
        head = self.orders.select(
            F.col("o_orderkey").alias("page_id"), F.lit(0).alias("line_no"),
            F.inline(F.array(
                box(0, 10, F.lit(10), F.lit("Item")), box(1, 90, F.lit(10), F.lit("Qty")),
                box(2, 160, F.lit(10), F.lit("Amount")),
            )),
        )
        return body.unionByName(head).withColumn("box_id", (F.col("line_no") * 10 + F.col("col_idx")).cast("long"))

    @cached_property
    def doc_lines(self) -> DataFrame:
        d, c = F.col("doc_id"), F.col("created_at")
        year = F.year(c) + F.when(d % 2 == 0, 543).otherwise(0)
        date = F.concat_ws(
            "/", F.lpad(F.dayofmonth(c).cast("string"), 2, "0"), F.lpad(F.month(c).cast("string"), 2, "0"),
            year.cast("string"))
        texts = [
            F.upper(F.replace("type", F.lit("_"), F.lit(" "))),
            F.concat(F.lit("Invoice Number: INV-"), (d - d % 3).cast("string")),
            F.concat(F.lit("Date: "), date),
            F.concat(F.lit("Vendor: "), "vendor_name"),
            F.concat(F.lit("Subtotal: "), F.col("subtotal").cast("string")),
            F.concat(F.lit("VAT: "), F.col("vat").cast("string")),
            F.concat(F.lit("Total: "), F.col("total_amount").cast("string")),
        ]
        rows = F.array(*[F.struct(F.lit(i).alias("line_no"), t.alias("text")) for i, t in enumerate(texts)])
        return self.invoice_docs.select("doc_id", F.inline(rows))

    @cached_property
    def raw_values(self) -> DataFrame:
        """Dates, amounts, ids and integers per order, in the forms that documents show."""
        k, d = F.col("o_orderkey"), F.col("o_orderdate")
        dd, mm = F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), F.lpad(F.month(d).cast("string"), 2, "0")
        yy, be = F.year(d).cast("string"), (F.year(d) + 543).cast("string")
        thai = F.translate(F.concat(dd, F.lit("/"), mm, F.lit("/"), be), "0123456789", "๐๑๒๓๔๕๖๗๘๙")
        date = (
            F.when(k % 7 == 0, F.concat(dd, F.lit("/"), mm, F.lit("/"), be)).when(k % 7 == 1, F.concat(yy, F.lit("-"), mm, F.lit("-"), dd))
            .when(k % 7 == 2, F.concat(dd, F.lit("/"), mm, F.lit("/"), F.substring(yy, 3, 2))).when(k % 7 == 3, F.concat(dd, F.lit("-"), mm, F.lit("-"), yy))
            .when(k % 7 == 4, F.concat(F.lit("31/02/"), yy)).when(k % 7 == 5, thai)
            .otherwise(F.concat(dd, F.lit(" กุมภาพันธ์ "), be)))
        price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
        us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
        amount = (
            F.when(k % 6 == 0, price).when(k % 6 == 1, F.concat(F.lit("$"), us)).when(k % 6 == 2, F.translate(us, ",.", ".,"))
            .when(k % 6 == 3, F.concat(k.cast("string"), F.lit(",5"))).when(k % 6 == 4, F.lit("about ten")).otherwise(F.lit("")))
        base = F.lpad((k * 7919 + 13).cast("string"), 13, "1")
        tax = F.when(k % 4 == 1, F.concat(F.substring(base, 1, 1), F.lit("-"), F.substr(base, F.lit(2)))).when(
            k % 4 == 2, F.substring(base, 1, 5)).otherwise(base)
        whole = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("No. 00"), k.cast("string"))).otherwise(F.lit("none"))
        pairs = F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("field_value")) for n, v in (
            ("date", date), ("currency", amount), ("tax_id", tax), ("integer", whole))])
        return self.orders.select(k.alias("value_id"), F.inline(pairs))

    @cached_property
    def item_fields(self) -> DataFrame:
        """Line items as named fields item_<n>_<column>; numbers have gaps."""
        lines = self.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
            F.min(F.struct("l_partkey", "l_quantity", "l_extendedprice")).alias("m"))
        o, n = F.col("l_orderkey"), F.col("l_linenumber")

        def item(i, name, value, conf):
            return F.struct((o * 1000 + n * 10 + i).alias("field_id"), F.concat(F.lit("item_"), n.cast("string"), F.lit("_" + name)).alias("field_name"),
                            value.cast("string").alias("field_value"), conf.cast("decimal(5,4)").alias("confidence"))

        pct = (o * 7 + n) % 101 * F.expr("0.01")
        rows = F.array(
            item(1, "description", F.concat(F.lit("Part "), F.col("m.l_partkey").cast("string")), F.lit(0.9)),
            item(2, "quantity", F.col("m.l_quantity").cast("decimal(18,2)"), pct),
            item(3, "amount", F.col("m.l_extendedprice").cast("decimal(18,2)"), F.when(n % 2 == 0, pct)))
        return lines.select(o.alias("doc_id"), F.inline(rows))

    @cached_property
    def job_events(self) -> DataFrame:
        return job_events_of(self.events)

    @cached_property
    def step_events(self) -> DataFrame:
        return step_events_of(self.events)

    @cached_property
    def audit_logs(self) -> DataFrame:
        t = F.col("event_type")
        return self.events.select(
            F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("actor_user_id"),
            F.when(t == "signup", "document.upload").when(t == "click", "field.update")
            .when(t == "view", "document.update").when(t == "purchase", "document.render_pages")
            .otherwise("document.delete").alias("action"),
            F.when(t == "click", "extracted_field").otherwise("document").alias("entity_type"),
            F.col("event_id").alias("document_id"), F.col("props").alias("meta"),
        )

    @cached_property
    def match_links(self) -> DataFrame:
        """Members of match sets: completed documents, four neighbouring ids per set."""
        d = F.col("doc_id")
        return self.invoice_docs.where(F.col("status") == "completed").select(
            (d - d % 4).alias("set_id"), d.alias("document_id"))

    @cached_property
    def doc_pages(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number")).distinct()

    @cached_property
    def users(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("user_id"), F.concat("c_name", F.lit("@example.org")).alias("email"))


def job_events_of(events: DataFrame) -> DataFrame:
    """Job history: eight consecutive events form one job. Works on batch and streaming frames."""
    e, t = F.col("event_id"), F.col("event_type")
    job = F.floor(e / 8)
    return events.select(
        "event_id", job.alias("job_id"), (job + 1).alias("document_id"),
        F.when(job % 3 == 0, "external").otherwise("easyocr").alias("provider"),
        F.when(t == "signup", "pending").when(t == "click", "triggered").when(t == "view", "running")
        .when(t == "purchase", "completed").otherwise("error").alias("status"),
        F.col("ts").alias("event_time"),
    )


def step_events_of(events: DataFrame) -> DataFrame:
    """Reports of job steps: eight consecutive events form one job, some report a failure or a cancellation."""
    e, t = F.col("event_id"), F.col("event_type")
    job = F.floor(e / 8)
    step = F.element_at(F.array(*[F.lit(s) for s in STEPS]), F.pmod(e * 3 + F.floor(job / 2), F.lit(4)).cast("int") + 1)
    return events.select(
        "event_id", job.alias("job_id"), step.alias("step"),
        F.when((t == "error") & (e % 3 == 0), "failed").when((t == "signup") & (e % 11 == 0), "cancelled").otherwise("done").alias("status"),
        F.col("ts").alias("event_time"))


VIEWS = {
    "step_events": """
select event_id, event_id // 8 as job_id, ['orchestrate', 'render', 'ocr', 'extract'][(event_id * 3 + event_id // 16) % 4 + 1] as step,
  case when event_type = 'error' and event_id % 3 = 0 then 'failed' when event_type = 'signup' and event_id % 11 = 0 then 'cancelled' else 'done' end as status, ts as event_time
from events""",
    "invoice_docs": """
select o.o_orderkey as doc_id, o.o_custkey as user_id, concat('DOC-', cast(o.o_orderkey as varchar)) as name,
  case o.o_orderkey % 4 when 0 then 'invoice' when 1 then 'receipt' when 2 then 'purchase_order' else 'tax_invoice' end as type,
  case o.o_orderstatus when 'F' then 'completed' when 'O' then 'processing' else 'needs_review' end as status,
  case when o.o_orderkey % 17 <> 0 then cast(c.c_nationkey as bigint) end as category_id,
  o.o_orderpriority as priority, cast(((o.o_orderkey * 37) % 101) * 0.01 as decimal(5,4)) as confidence,
  o.o_orderdate as created_at, c.c_name as vendor_name, l.subtotal, l.vat,
  cast(case when o.o_orderkey % 10 = 0 then l.subtotal + l.vat + 7 else l.subtotal + l.vat end as decimal(18,2)) as total_amount,
  l.line_count
from orders o
join customer c on c.c_custkey = o.o_custkey
join (select l_orderkey,
        cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as subtotal,
        cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2))) as decimal(18,2)) as vat,
        count(*) as line_count
      from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey""",
    "extracted_fields": """
select doc_id, created_at, doc_id * 10 + s.n as field_id, s.n % 2 + 1 as page_number,
  case s.n when 1 then 'invoice_number' when 2 then 'subtotal' when 3 then 'vat' when 4 then 'total_amount' else 'vendor_name' end as field_name,
  case s.n when 1 then concat('INV-', cast(doc_id - doc_id % 3 as varchar)) when 2 then cast(subtotal as varchar)
    when 3 then cast(vat as varchar) when 4 then cast(total_amount as varchar) else vendor_name end as field_value,
  cast(case s.n when 1 then 95 when 2 then (doc_id * 13) % 101 when 3 then (doc_id * 17) % 101 when 4 then (doc_id * 19) % 101 else 90 end * 0.01 as decimal(5,4)) as confidence,
  case s.n when 1 then doc_id % 11 = 0 when 2 then doc_id % 7 = 0 when 3 then doc_id % 5 = 0 when 4 then doc_id % 3 = 0 else false end as is_corrected,
  doc_id % 6 = s.n as is_edited
from invoice_docs cross join (values (1), (2), (3), (4), (5)) s(n)""",
    "sparse_fields": "select * from extracted_fields where not is_corrected",
    "field_corrections": """
select event_id as correction_id, f.field_id, e.user_id, e.ts as corrected_at, f.field_value as original_value,
  case when e.event_id % 13 = 0 then null else concat(f.field_value, '*') end as corrected_value,
  case e.event_type when 'click' then 'ocr_error' when 'view' then 'extraction_error' when 'purchase' then 'format_error' when 'signup' then 'missing' else 'other' end as correction_reason,
  case e.event_id % 5 when 0 then 'excellent' when 1 then 'good' when 2 then 'poor' when 3 then 'unusable' else null end as feedback_sentiment,
  e.value > 200 as is_critical, cast((e.event_id % 41 - 20) * 0.01 as decimal(5,4)) as confidence_adjustment
from events e join extracted_fields f on f.field_id = (e.event_id // 12) * 10 + 1 + (e.event_id % 5)""",
    "ocr_boxes": """
select l_orderkey as page_id, l_linenumber as line_no, c.col_idx, l_linenumber * 10 + c.col_idx as box_id,
  cast(c.x_min as double) as x_min, cast(c.x_min + 70 as double) as x_max,
  cast(30 * l_linenumber + 10 as double) as y_min, cast(30 * l_linenumber + 30 as double) as y_max,
  case c.col_idx when 0 then concat('Part ', cast(l_partkey as varchar)) when 1 then cast(cast(l_quantity as decimal(18,2)) as varchar) else cast(cast(l_extendedprice as decimal(18,2)) as varchar) end as text
from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) as rn from lineitem) li
cross join (values (0, 10), (1, 90), (2, 160)) as c(col_idx, x_min) where rn = 1
union all select o_orderkey, 0, h.col_idx, h.col_idx, cast(h.x_min as double), cast(h.x_min + 70 as double), 10.0, 30.0, h.t
from orders cross join (values (0, 10, 'Item'), (1, 90, 'Qty'), (2, 160, 'Amount')) as h(col_idx, x_min, t)""",
    "doc_lines": """
select doc_id, 0 as line_no, upper(replace(type, '_', ' ')) as text from invoice_docs
union all select doc_id, 1, concat('Invoice Number: INV-', cast(doc_id - doc_id % 3 as varchar)) from invoice_docs
union all select doc_id, 2, concat('Date: ', concat_ws('/', lpad(cast(day(created_at) as varchar), 2, '0'), lpad(cast(month(created_at) as varchar), 2, '0'), cast(year(created_at) + case when doc_id % 2 = 0 then 543 else 0 end as varchar))) from invoice_docs
union all select doc_id, 3, concat('Vendor: ', vendor_name) from invoice_docs
union all select doc_id, 4, concat('Subtotal: ', cast(subtotal as varchar)) from invoice_docs
union all select doc_id, 5, concat('VAT: ', cast(vat as varchar)) from invoice_docs
union all select doc_id, 6, concat('Total: ', cast(total_amount as varchar)) from invoice_docs""",
    "raw_values": """
with o as (select o_orderkey as k, lpad(cast(day(o_orderdate) as varchar), 2, '0') as dd, lpad(cast(month(o_orderdate) as varchar), 2, '0') as mm,
  cast(year(o_orderdate) as varchar) as yy, cast(year(o_orderdate) + 543 as varchar) as be, cast(o_totalprice as decimal(18,2)) as price,
  format('{:,.2f}', o_totalprice) as us, lpad(cast(o_orderkey * 7919 + 13 as varchar), 13, '1') as base from orders)
select k as value_id, 'date' as kind, case k % 7 when 0 then concat(dd, '/', mm, '/', be) when 1 then concat(yy, '-', mm, '-', dd) when 2 then concat(dd, '/', mm, '/', substr(yy, 3, 2))
  when 3 then concat(dd, '-', mm, '-', yy) when 4 then concat('31/02/', yy) when 5 then translate(concat(dd, '/', mm, '/', be), '0123456789', '๐๑๒๓๔๕๖๗๘๙') else concat(dd, ' กุมภาพันธ์ ', be) end as field_value from o
union all select k, 'currency', case k % 6 when 0 then cast(price as varchar) when 1 then concat('$', us) when 2 then translate(us, ',.', '.,') when 3 then concat(cast(k as varchar), ',5') when 4 then 'about ten' else '' end from o
union all select k, 'tax_id', case k % 4 when 1 then concat(substr(base, 1, 1), '-', substr(base, 2)) when 2 then substr(base, 1, 5) else base end from o
union all select k, 'integer', case k % 3 when 0 then cast(k as varchar) when 1 then concat('No. 00', cast(k as varchar)) else 'none' end from o""",
    "item_fields": """
with li as (select l_orderkey as o, l_linenumber as n, l_partkey, l_quantity, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_quantity, l_extendedprice) as rn from lineitem) where rn = 1)
select o as doc_id, o * 1000 + n * 10 + 1 as field_id, concat('item_', cast(n as varchar), '_description') as field_name, concat('Part ', cast(l_partkey as varchar)) as field_value, cast(0.9 as decimal(5,4)) as confidence from li
union all select o, o * 1000 + n * 10 + 2, concat('item_', cast(n as varchar), '_quantity'), cast(cast(l_quantity as decimal(18,2)) as varchar), cast((o * 7 + n) % 101 * 0.01 as decimal(5,4)) from li
union all select o, o * 1000 + n * 10 + 3, concat('item_', cast(n as varchar), '_amount'), cast(cast(l_extendedprice as decimal(18,2)) as varchar), case when n % 2 = 0 then cast((o * 7 + n) % 101 * 0.01 as decimal(5,4)) end from li""",
    "job_events": """
select event_id, event_id // 8 as job_id, (event_id // 8) + 1 as document_id, case when (event_id // 8) % 3 = 0 then 'external' else 'easyocr' end as provider,
  case event_type when 'signup' then 'pending' when 'click' then 'triggered' when 'view' then 'running' when 'purchase' then 'completed' else 'error' end as status, ts as event_time
from events""",
    "audit_logs": """
select event_id as id, ts as created_at, user_id as actor_user_id,
  case event_type when 'signup' then 'document.upload' when 'click' then 'field.update' when 'view' then 'document.update' when 'purchase' then 'document.render_pages' else 'document.delete' end as action,
  case when event_type = 'click' then 'extracted_field' else 'document' end as entity_type, event_id as document_id, props as meta
from events""",
    "match_links": """
select doc_id - doc_id % 4 as set_id, doc_id as document_id from invoice_docs where status = 'completed'""",
    "doc_pages": """
select distinct l_orderkey as doc_id, l_linenumber as page_number from lineitem""",
    "users": """
select c_custkey as user_id, concat(c_name, '@example.org') as email from customer""",
}

NEEDS = {
    "extracted_fields": ["invoice_docs"], "doc_lines": ["invoice_docs"], "match_links": ["invoice_docs"],
    "field_corrections": ["extracted_fields"], "sparse_fields": ["extracted_fields"],
}


def with_views(names: list[str], sql: str) -> str:
    """Prefix ``sql`` with the named derived views (and what they need) as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    body = sql.strip()
    if not ordered:
        return body
    # Materialized views under a LIMIT can make the check engine wait for ever.
    ctes = ",\n".join(f"{n} as not materialized ({VIEWS[n].strip()})" for n in ordered)
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
