"""Sources, exports, job history and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import audit as AU
from ledgerlens.operators import documents as D
from ledgerlens.operators import jobs as J
from ledgerlens.operators.validation import wide_fields
from ledgerlens.plans.fixtures import job_events_of, step_events_of
from ledgerlens.plans.registry import query
from ledgerlens.sources import export as X
from ledgerlens.session import scratch_path
from ledgerlens.sources import html_tables, ocr
from ledgerlens.streaming import changes as CH
from ledgerlens.streaming import jobs as SJ
from ledgerlens.streaming import tracker as TR
from ledgerlens.streaming.runner import (
    dealt_events, last_per_key, marker_folder, read_events, rocksdb_state, run_available, run_now, run_to_end, write_batches,
)

# Payloads of an external OCR engine, built from the documents


def payload_of(docs):
    d = F.col("doc_id")

    def field(page, value, left):
        return F.struct(F.lit(page).alias("page"), value.cast("string").alias("value"), F.struct(
            F.lit(0.25).alias("top"), F.lit(left).alias("left"), F.lit(0.75).alias("right"), F.lit(0.5).alias("bottom")).alias("bbox"))

    data = F.create_map(F.lit("Total"), field(1, F.col("total_amount"), 0.5), F.lit("Vendor"), field(2, F.col("vendor_name"), 0.25))
    result = F.array(F.struct(F.upper("type").alias("doc_type"), F.array(F.lit(1), (d % 4 + 1).cast("int"), F.lit(2)).alias("pages"), data.alias("data")))
    good = d % 9 != 0
    return docs.select("doc_id", "created_at", F.to_json(F.struct(
        good.alias("status"), F.when(d % 18 == 0, "timeout").alias("error"), d.alias("request_id"), F.lit("iface").alias("interface_id"),
        F.concat(F.lit("tx-"), d.cast("string")).alias("transaction_id"), F.when(good, result).alias("result"))).alias("payload"))


@query("S2", views="invoice_docs", sql="""
select doc_id as request_id, f.n as field_name, f.p as page_number, case f.n when 'Total' then cast(total_amount as varchar) else vendor_name end as field_value,
  f.x::double as x, 0.25::double as y, (0.75 - f.x)::double as width, 0.25::double as height
from invoice_docs cross join (values ('Total', 1, 0.5), ('Vendor', 2, 0.25)) f(n, p, x) where doc_id % 9 <> 0""")
def external_payload_fields(t):
    return ocr.payload_fields(ocr.parse_payloads(payload_of(t.invoice_docs)))


@query("S2", views="invoice_docs", sql="""
select doc_id as request_id, concat('tx-', cast(doc_id as varchar)) as transaction_id, case when doc_id % 9 <> 0 then 'completed' else 'error' end as job_status,
  case when doc_id % 18 = 0 then 'timeout' when doc_id % 9 = 0 then 'External OCR error' end as error_message,
  case when doc_id % 9 <> 0 then upper(type) end as document_type, case when doc_id % 9 <> 0 then greatest(2, doc_id % 4 + 1) else -1 end as page_count from invoice_docs""")
def external_payload_jobs(t):
    j = ocr.payload_jobs(ocr.parse_payloads(payload_of(t.invoice_docs)))
    return j.withColumn("page_count", F.coalesce("page_count", F.lit(-1)))


@query("J15", views="invoice_docs", sql="""
select doc_id as request_id, case when doc_id % 2 = 0 or doc_id % 3 = 0 then doc_id * 10 else -1 end as job_id from invoice_docs""")
def payload_job_lookup(t):
    d = F.col("doc_id")
    tx = F.concat(F.lit("tx-"), d.cast("string"))
    jobs = t.invoice_docs.where((d % 2 == 0) | (d % 3 == 0)).select(
        (d * 10).alias("job_id"), F.when(d % 2 == 0, d).alias("request_id"), F.when(d % 2 != 0, tx).alias("transaction_id"))
    payloads = t.invoice_docs.select(d.alias("request_id"), tx.alias("transaction_id"))
    return ocr.resolve_jobs(payloads, jobs).select("request_id", F.coalesce("job_id", F.lit(-1)).alias("job_id"))


def quads(t):
    return t.ocr_boxes.withColumn("quad", F.array(F.array("x_min", "y_min"), F.array("x_max", "y_min"), F.array("x_max", "y_max"), F.array("x_min", "y_max")))


@query("S3", views="ocr_boxes", sql="""
select page_id as doc_id, concat('text_', cast(row_number() over (partition by page_id order by box_id) - 1 as varchar)) as field_name, text as field_value,
  0.5::double as confidence, 1 as page_number, x_min as x, y_min as y, 70::double as width, 20::double as height from ocr_boxes""")
def quad_box_fields(t):
    entry = F.struct("box_id", F.col("quad").alias("bbox"), "text", F.lit(0.5).alias("confidence"))
    raw = quads(t).groupBy(F.col("page_id").alias("doc_id")).agg(F.sort_array(F.collect_list(entry)).alias("r"))
    return ocr.quad_fields(raw.select("doc_id", F.to_json(F.transform("r", lambda r: F.struct(
        r["bbox"].alias("bbox"), r["text"].alias("text"), r["confidence"].alias("confidence")))).alias("results")))


@query("S4", views="ocr_boxes", sql="""
select page_id as doc_id, concat('text_', cast(row_number() over (partition by page_id order by box_id) - 1 as varchar)) as field_name, text as field_value,
  0.75::double as confidence, dense_rank() over (partition by page_id order by line_no) as page_number, x_min as x, y_min as y, 70::double as width, 20::double as height from ocr_boxes""")
def paged_ocr_fields(t):
    """Every line of a page as a page of its own, each with one short entry that must be skipped."""
    entry = F.concat(F.lit("["), F.to_json("quad"), F.lit(',["  '), "text", F.lit(' ",0.75]]'))
    lines = quads(t).groupBy(F.col("page_id").alias("doc_id"), "line_no").agg(F.sort_array(F.collect_list(F.struct("box_id", entry.alias("e")))).alias("es"))
    page = F.concat(F.lit("[[[]],"), F.array_join("es.e", ","), F.lit("]"))
    raw = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", page.alias("p")))).alias("ps"))
    out = ocr.paged_fields(raw.select("doc_id", F.concat(F.lit("["), F.array_join("ps.p", ","), F.lit("]")).alias("results")))
    return out.withColumn("page_number", F.col("page_number").cast("long"))


@query("S5", views="ocr_boxes", sql="""
with l as (select page_id, line_no, row_number() over (partition by page_id order by line_no) as r, count(*) over (partition by page_id) as n,
  max(case when col_idx = 1 then text end) as qty, max(case when col_idx = 2 then text end) as amount from ocr_boxes where line_no > 0 group by page_id, line_no)
select o_orderkey as page_id, 0 as row_idx, 0 as col_idx, 1 as row_span, 2 as col_span, 'Item' as text from orders
union all select o_orderkey, 0, 2, 1, 1, 'Amount' from orders
union all select page_id, 1, 0, n, 1, concat('order ', cast(page_id as varchar)) from l where r = 1
union all select page_id, r, 1, 1, 1, qty from l union all select page_id, r, 2, 1, 1, amount from l""")
def html_table_cells(t):
    """HTML tables with spans built from the line items: the first cell spans all lines of its order."""
    lines = t.ocr_boxes.where(F.col("line_no") > 0).groupBy("page_id", "line_no").agg(
        F.max(F.when(F.col("col_idx") == 1, F.col("text"))).alias("qty"), F.max(F.when(F.col("col_idx") == 2, F.col("text"))).alias("amount"))
    rows = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "qty", "amount"))).alias("r"))
    j = t.orders.select(F.col("o_orderkey").alias("page_id")).join(rows, "page_id", "left")
    first = F.concat(F.lit('<td rowspan="'), F.size("r").cast("string"), F.lit('">order '), F.col("page_id").cast("string"), F.lit("</td>"))
    body = F.array_join(F.transform("r", lambda x, i: F.concat(
        F.lit("<tr>"), F.when(i == 0, first).otherwise(""), F.lit("<td>"), x["qty"], F.lit("</td><td> "), x["amount"], F.lit(" </td></tr>"))), "\n")
    html = F.concat(F.lit('<html><body><table><tr><td colspan="2">Item</td><td>Amount</td></tr>'), F.coalesce(body, F.lit("")), F.lit("</table></body></html>"))
    return html_tables.html_cells(j.select("page_id", html.alias("html")), "page_id").withColumn("row_idx", F.col("row_idx").cast("long")).withColumn(
        "row_span", F.col("row_span").cast("long"))


# Export

RULES = [
    X.MappingRule("invoice_number", "DocNo", required=True, transform="lowercase"), X.MappingRule("total_amount", "Total", "decimal", required=True),
    X.MappingRule("vendor_name", "Vendor", transform="uppercase"), X.MappingRule("currency", "Currency", default="EUR"),
    X.MappingRule("due_date", "Due", "date"),
]
NAMES = ["invoice_number", "subtotal", "vat", "total_amount", "vendor_name"]
WIDE = """w as (select doc_id, """ + ", ".join(f"max(case when field_name = '{n}' then field_value end) as {n}" for n in NAMES) + " from extracted_fields group by doc_id)"
MAPPED = WIDE + ", m as (select doc_id, lower(invoice_number) as DocNo, total_amount as Total, upper(vendor_name) as Vendor, 'EUR' as Currency from w)"
STAMP = "2024-01-31T00:00:00"


def mapped(t):
    return X.apply_mapping(wide_fields(t.extracted_fields, NAMES), RULES)


@query("S6 U2", views="extracted_fields", sql=f"""with {WIDE}
select cast(d.doc_id as varchar) as doc_id, d.name, d.type, w.invoice_number, w.subtotal, w.total_amount, w.vat, w.vendor_name, '' as tag from invoice_docs d join w on w.doc_id = d.doc_id where d.type <> 'receipt'
union all select cast(doc_id as varchar), name, type, '', '', '', '', '', concat('k', cast(doc_id % 5 as varchar)) from invoice_docs where type = 'receipt'""")
def wide_csv_frame(t):
    d = t.invoice_docs.select("doc_id", "name", "type")
    full = d.where(F.col("type") != "receipt").join(wide_fields(t.extracted_fields, NAMES), "doc_id")
    short = d.where(F.col("type") == "receipt").withColumn("tag", F.concat(F.lit("k"), (F.col("doc_id") % 5).cast("string")))
    return X.csv_frame(X.wide_union(full, short))


@query("S8 S7", views="extracted_fields", sql=f"""with {MAPPED}
select m.doc_id, json_object('document_id', m.doc_id, 'document_type', d.type, 'fields', json_object('DocNo', DocNo, 'Total', Total, 'Vendor', Vendor, 'Currency', Currency), 'exported_at', '{STAMP}')::varchar as json
from m join invoice_docs d on d.doc_id = m.doc_id""")
def json_documents(t):
    return X.json_documents(t.invoice_docs, mapped(t), STAMP)


@query("S7", views="invoice_docs", sql=f"select 'export-1' as export_id, 'json' as export_format, count(*) as document_count, '{STAMP}' as exported_at from invoice_docs")
def json_envelope(t):
    return X.export_envelope(X.json_documents(t.invoice_docs, mapped(t), STAMP), "export-1", STAMP)


@query("S9 P8", views="extracted_fields", sql=f"with {MAPPED} select cast(doc_id as varchar) as doc_id, DocNo, Total, Vendor, Currency, '' as Due from m")
def mapped_csv_frame(t):
    return X.csv_frame(mapped(t))


@query("S6", views="extracted_fields item_fields", sql="select doc_id, " + ", ".join(
    f"max(case when field_name = '{n}' then field_value end) as {n}" for n in (
        *NAMES, *(f"item_{i}_{c}" for i in range(1, 8) for c in ("amount", "description", "quantity")))) + """
from (select doc_id, field_name, field_value from extracted_fields union all select doc_id, field_name, field_value from item_fields) group by doc_id""")
def csv_union_of_keys(t):
    """Columns are the field names that the data has."""
    return X.wide_of_keys(t.extracted_fields.select("doc_id", "field_id", "field_name", "field_value").union(t.item_fields.select("doc_id", "field_id", "field_name", "field_value")))


@query("P8 X44", views="extracted_fields", sql=f"with {MAPPED} select doc_id, DocNo, true as DocNo_ok, cast(Total as double) as Total, true as Total_ok, Vendor, Currency from m")
def typed_mapping(t):
    typed = X.apply_typed_mapping(wide_fields(t.extracted_fields, NAMES), RULES)
    return typed.select("doc_id", "DocNo", "DocNo_ok", "Total", "Total_ok", "Vendor", "Currency")


@query("P8", views="sparse_fields", sql="""
select doc_id, max(case when field_name = 'vat' then field_value end) as Vat, coalesce(max(case when field_name = 'total_amount' then field_value end), 'unknown') as Total
from sparse_fields group by doc_id""")
def mapping_with_defaults(t):
    rules = [X.MappingRule("vat", "Vat"), X.MappingRule("total_amount", "Total", default="unknown")]
    return X.map_long(t.sparse_fields, rules)


@query("P13", views="sparse_fields", sql="""
with p as (select doc_id, bool_or(field_name = 'invoice_number') as a, bool_or(field_name = 'total_amount') as b, bool_or(field_name = 'vendor_name') as c from sparse_fields group by doc_id)
select doc_id, 5 as field_count_total, a::int + b::int + c::int as field_count_exported, (not a)::int + (not b)::int as errors, (not c)::int + 1 as warnings, a and b as is_valid from p""")
def export_validation(t):
    return X.validate_export(t.invoice_docs, t.sparse_fields, RULES)[0]


@query("P13", views="sparse_fields", sql="""
with p as (select doc_id, bool_or(field_name = 'invoice_number') as a, bool_or(field_name = 'total_amount') as b, bool_or(field_name = 'vendor_name') as c from sparse_fields group by doc_id)
select 'invoice_number' as field_name, 'error' as severity, count(*) as documents from p where not a union all select 'total_amount', 'error', count(*) from p where not b
union all select 'due_date', 'warning', count(*) from p""")
def export_issues(t):
    issues = X.validate_export(t.invoice_docs, t.sparse_fields, RULES)[1]
    return issues.groupBy("field_name", "severity").agg(F.count("*").alias("documents"))


@query("S10", views="extracted_fields item_fields", sql=f"""with {MAPPED},
i as (select distinct doc_id, cast(regexp_extract(field_name, '_([0-9]+)_', 1) as int) as n from item_fields where not regexp_matches(field_name, '_0')),
k as (select doc_id, n from (select *, row_number() over (partition by doc_id order by n) as rn from i) where n = rn)
select m.doc_id, 'AP_INVOICE' as document_type, json_object('DocNo', DocNo, 'Total', Total)::varchar as header, 0 as part,
  coalesce((select string_agg(concat(cast(k.n as varchar), ':', f.field_value), ',' order by k.n) from k join item_fields f on f.doc_id = k.doc_id and f.field_name = concat('item_', cast(k.n as varchar), '_quantity') where k.doc_id = m.doc_id), '') as items from m""")
def erp_documents(t):
    items = X.contiguous_items(X.item_columns(t.item_fields, "item_", ["quantity", "amount"]))
    erp = X.erp_documents(mapped(t), ["DocNo", "Total", "Absent"], items, "AP_INVOICE")
    pairs = F.transform("line_items", lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["quantity"]))
    return erp.select("doc_id", "document_type", F.to_json("header").alias("header"), "part", F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("items"))


@query("S10", views="extracted_fields", sql=f"with {MAPPED} select cast(doc_id as varchar) as doc_id, Vendor, DocNo, Total, Currency, '' as Due from m")
def erp_flat_frame(t):
    return X.erp_flat(mapped(t), ["Vendor", "DocNo"])


# Job history

TIMELINE = """with tl as (select *, lead(event_time) over w as nxt, count(*) filter (where status = 'error') over (partition by job_id order by event_time, event_id rows unbounded preceding) as failures
  from job_events window w as (partition by job_id order by event_time, event_id))"""


@query("W10", views="job_events", sql=TIMELINE + """
select job_id, event_id, status, coalesce(epoch_us(nxt) - epoch_us(event_time), -1) as micros_in_state, failures from tl""")
def job_timeline(t):
    return J.job_timeline(t.job_events).select(
        "job_id", "event_id", "status", F.coalesce("micros_in_state", F.lit(-1)).alias("micros_in_state"), "failures")


RETRIES = TIMELINE + """
select job_id, event_id, failures as attempt, case when failures >= 3 then 'dead_letter' else 'retry' end as outcome,
  case when failures >= 3 then 0 else least(60, 5 * (1 << (failures - 1)::int)) end as delay_seconds from tl where status = 'error'"""


@query("W10 T2", views="job_events", sql=RETRIES)
def job_retries(t):
    return J.retries(J.job_timeline(t.job_events)).withColumn("delay_seconds", F.coalesce("delay_seconds", F.lit(0)))


@query("W10", views="job_events", sql=TIMELINE + " select event_id, 10 * (cast(1 as bigint) << (failures * 9)::int) as delay from tl where status = 'error'")
def requeue_delays(t):
    tl = J.job_timeline(t.job_events).where("status = 'error'")
    return tl.select("event_id", J.requeue_seconds(F.col("failures") * 9).alias("delay"))


@query("T3", views="job_events", sql=TIMELINE + " select job_id, event_id from tl where status = 'running' and (nxt is null or epoch_us(nxt) - epoch_us(event_time) > 300000000)")
def stuck_jobs(t):
    return J.stuck(J.job_timeline(t.job_events)).select("job_id", "event_id")


FROZEN = """with f as (select job_id, coalesce(min_by(status, (event_time, event_id)) filter (where status in ('completed', 'error', 'cancelled')), max_by(status, (event_time, event_id))) as status
  from job_events group by job_id)"""


@query("T1", views="job_events", sql=FROZEN + " select * from f")
def frozen_job_states(t):
    return J.frozen_states(t.job_events)


STEP_STATES = """with e as (select *, (event_time, event_id) as place from step_events),
j as (select job_id, count(*) as total, min(place) filter (where status <> 'done') as ending, min_by(status, place) filter (where status <> 'done') as how,
  """ + ", ".join(f"min(place) filter (where status = 'done' and step = '{s}') as s{i}" for i, s in enumerate(J.STEPS)) + """ from e group by job_id),
k as (select *, """ + ", ".join(f"(s{i} is not null and (ending is null or s{i} < ending)) as d{i}" for i in range(len(J.STEPS))) + """ from j),
a as (select *, case when not d0 then 0 when not d1 then 1 when not d2 then 2 when not d3 then 3 else 4 end as ahead, d0::int + d1::int + d2::int + d3::int as used from k),
s as (select job_id, ['orchestrate', 'render', 'ocr', 'extract', 'extract'][ahead + 1] as step,
  case when ahead = 4 then 'completed' when ending is null then 'pending' when how = 'failed' then 'error' else 'cancelled' end as status,
  cast(total - used - (ahead < 4 and ending is not null)::int as bigint) as refused from a)"""


@query("T1", views="step_events", sql=STEP_STATES + " select * from s")
def job_steps(t):
    return J.job_steps(t.step_events)


# Streams: each runs over the event table as a stream and is checked against the batch form


@query("T1", views="job_events", sql=FROZEN + " select * from f")
def stream_job_states(t):
    states = SJ.job_states(job_events_of(read_events(t.spark, t.sf_dir)))
    return last_per_key(run_now(states, "job-states", "update"), ["job_id"])


@query("T1", views="step_events", sql=STEP_STATES + " select * from s")
def stream_job_steps(t):
    """Reports arrive in five micro-batches without regard to time; the newest row of each job must be the batch form's."""
    with rocksdb_state(t.spark):
        events = dealt_events(t.spark, t.sf_dir, 5)
        out = run_now(TR.job_steps(step_events_of(events), late="60 days"), "job-steps")
    return last_per_key(out, ["job_id"]).select("job_id", "step", "status", "refused")


@query("T10 A22", views="step_events", sql=STEP_STATES + " select step, status, count(*) as jobs from s group by all")
def stream_backlog(t):
    """Two streams: the tracker's changes, and the running sums of the changes."""
    path = scratch_path(t.spark, "backlog-changes")
    with rocksdb_state(t.spark):
        events = dealt_events(t.spark, t.sf_dir, 5)
        changes = TR.backlog_changes(TR.job_steps(step_events_of(events), late="60 days"))
        run_available(changes, path, write_batches(path))
    changed = t.spark.readStream.schema(changes.schema).parquet(f"{path}/out/batch_id=*")
    sums = last_per_key(run_now(TR.live_backlog(changed), "backlog", "update"), ["step", "status"])
    return sums.where("jobs > 0")


def retry_sinks(t):
    """The two sinks of one stream of failures: retries and dead letters."""
    path = scratch_path(t.spark, "retries")
    with rocksdb_state(t.spark):
        run_available(SJ.retries(job_events_of(read_events(t.spark, t.sf_dir))), path, write_batches(path, SJ.RETRY_SINKS))
    return {name: t.spark.read.parquet(f"{path}/{name}").drop("batch_id") for name in SJ.RETRY_SINKS}


@query("T2", views="job_events", sql=RETRIES)
def stream_retries(t):
    sinks = retry_sinks(t)
    return sinks["retries"].union(sinks["dead_letters"])


@query("T2", views="job_events", sql=TIMELINE + " select job_id, event_id, failures as attempt from tl where status = 'error' and failures >= 3")
def stream_dead_letters(t):
    return retry_sinks(t)["dead_letters"].select("job_id", "event_id", "attempt")


@query("T3", views="job_events", sql=TIMELINE + " select job_id, event_id from tl where status = 'running' and (nxt is null or epoch_us(nxt) - epoch_us(event_time) > 300000000)")
def stream_stuck_jobs(t):
    """All stuck jobs: the stream is closed at its end, so those whose limit the watermark had not passed come out, too."""
    marker = marker_folder(t.spark)
    with rocksdb_state(t.spark):
        out = run_to_end(SJ.stuck_jobs(job_events_of(read_events(t.spark, t.sf_dir, marker=marker))), "stuck", marker)
    return out.where("job_id >= 0").drop("batch_id")


CORRECTIONS = """with c as (select *, case event_type when 'click' then 'ocr_error' when 'view' then 'extraction_error' when 'purchase' then 'format_error' when 'signup' then 'missing' else 'other' end as correction_reason from events)"""


def corrections(t):
    return SJ.correction_events(read_events(t.spark, t.sf_dir))


@query("T4", sql=CORRECTIONS + """
select cast(cast(ts as date) as varchar) as day, correction_reason, count(*) as corrections, count(*) filter (where value > 200) as critical from c group by all""")
def stream_daily_corrections(t):
    return last_per_key(run_now(SJ.daily_corrections(corrections(t)), "daily", "update"), ["day", "correction_reason"])


@query("T5", sql="""
select cast(w.d as varchar) as window_start, count(*) as corrections
from events e join (select cast(unnest(generate_series(date '2023-12-01', date '2024-03-01', interval 1 day)) as date) as d) w on cast(e.ts as date) >= w.d and cast(e.ts as date) < w.d + 7 group by w.d""")
def stream_moving_corrections(t):
    return last_per_key(run_now(SJ.moving_corrections(corrections(t)), "moving", "update"), ["window_start"])


@query("T6", sql="""
with s as (select *, case when ts - lag(ts) over w >= interval 30 minute or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
n as (select *, sum(new) over (partition by user_id order by ts, event_id) as no from s)
select user_id, count(*) as corrections, epoch_us(min(ts)) as started_us, epoch_us(max(ts)) as completed_us from n group by user_id, no""")
def stream_sessions(t):
    """All sessions: the stream is closed at its end."""
    marker = marker_folder(t.spark)
    out = run_to_end(SJ.correction_sessions(SJ.correction_events(read_events(t.spark, t.sf_dir, marker=marker))), "sessions", marker)
    return out.where("user_id >= 0").select("user_id", "corrections", F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"))


@query("T7", sql="""
select event_id // 2 as request_id, 'Total' as field_name, 1 as page_number, cast(event_id // 2 * 3 as varchar) as field_value from events group by all""")
def stream_payload_ingest(t):
    """Every request comes twice as JSON lines, its copy in a later micro-batch and after a restart; one result each must remain."""
    spark, e = t.spark, F.col("event_id")
    r = F.floor(e / 2)
    value = F.struct(F.lit(1).alias("page"), (r * 3).cast("string").alias("value"))
    payload = F.to_json(F.struct(F.lit(True).alias("status"), r.alias("request_id"), F.array(F.struct(F.create_map(F.lit("Total"), value).alias("data"))).alias("result")))
    folder, path = scratch_path(spark, "payloads"), scratch_path(spark, "ingested")
    for copy in (0, 1):
        t.events.where(e % 2 == copy).select(payload.alias("value")).write.mode("append").text(folder)
        run_available(CH.payload_files(spark, folder), path, CH.ingest_once(path))
    return spark.read.parquet(f"{path}/results").select("request_id", "field_name", "page_number", "field_value")


@query("T8", sql="""
with d as (select event_id as doc_id, cast(event_id % 101 * 0.01 as decimal(5,4)) as c, cast((event_id * 13) % 101 * 0.01 as decimal(5,4)) as c1, cast(greatest((event_id * 17) % 101, 40) * 0.01 as decimal(5,4)) as c2 from events),
h as (select *, case when doc_id % 5 = 0 then cast(c1 as double) else cast(c1 + c2 as double) / 2 end as header_avg from d),
s as (select *, case when header_avg > 0.9 then 'approved' when header_avg >= 0.7 then 'review_required' else 'rejected' end as header_status from h)
select doc_id, header_avg, header_status, case when header_status = 'rejected' then 'rejected' when header_status <> 'approved' then 'review_required'
  when c > 0.9 then 'approved' when c >= 0.7 then 'review_required' else 'rejected' end as routing_status,
  case when c > 0.9 then 'high' when c >= 0.7 then 'medium' else 'low' end as level,
  (c1 < 0.7)::int + (case when doc_id % 5 = 0 then 0 else c2 end < 0.7)::int as low_fields from s""")
def stream_routing(t):
    e = F.col("event_id")
    pct = "decimal(5,4)"
    c1 = ((e * 13) % 101 * F.expr("0.01")).cast(pct)
    c2 = F.when(e % 5 != 0, (F.greatest((e * 17) % 101, F.lit(40)) * F.expr("0.01")).cast(pct))
    docs = read_events(t.spark, t.sf_dir).select(
        e.alias("doc_id"), (e % 101 * F.expr("0.01")).cast(pct).alias("confidence"),
        F.array(F.struct(F.lit("a").alias("field_name"), c1.alias("confidence")), F.struct(F.lit("b").alias("field_name"), c2.alias("confidence"))).alias("fields"))
    return run_now(SJ.route_nested(docs, "strict"), "routing").drop("batch_id")


GROUPED = """
with d as (select event_id as doc_id, cast(event_id % 101 * 0.01 as decimal(5,4)) as c, event_id % 7 <> 0 as f1, event_id % 7 <> 0 and event_id % 5 <> 0 as f2,
  cast((event_id * 13) % 101 * 0.01 as decimal(5,4)) as c1, case when event_id % 3 <> 0 then cast(greatest((event_id * 17) % 101, 40) * 0.01 as decimal(5,4)) end as c2 from events),
h as (select *, case when not f1 then 0.0 else cast(c1 + case when f2 then coalesce(c2, 0) else 0 end as double) / (1 + (f2 and c2 is not null)::int) end as header_avg from d),
s as (select *, case when header_avg > 0.9 then 'approved' when header_avg >= 0.7 then 'review_required' else 'rejected' end as header_status from h)
select doc_id, header_avg, header_status, case when header_status = 'rejected' then 'rejected' when header_status <> 'approved' then 'review_required'
  when c > 0.9 then 'approved' when c >= 0.7 then 'review_required' else 'rejected' end as routing_status,
  case when c > 0.9 then 'high' when c >= 0.7 then 'medium' else 'low' end as level, (f1 and c1 < 0.7)::int + (f2 and coalesce(c2, 0) < 0.7)::int as low_fields from s"""


def documents_and_fields(events):
    """Documents, and their fields, which come a minute or twenty after them; every seventh document has none."""
    e, pct = F.col("event_id"), "decimal(5,4)"
    at = F.col("ts").cast("timestamp")
    docs = events.select(e.alias("doc_id"), at.alias("at"), (e % 101 * F.expr("0.01")).cast(pct).alias("confidence"))
    first = F.struct((at + F.expr("interval 1 minute")).alias("field_at"), ((e * 13) % 101 * F.expr("0.01")).cast(pct).alias("confidence"))
    second = F.struct((at + F.expr("interval 20 minutes")).alias("field_at"),
                      F.when(e % 3 != 0, (F.greatest((e * 17) % 101, F.lit(40)) * F.expr("0.01")).cast(pct)).alias("confidence"))
    fields = events.where(e % 7 != 0).select(e.alias("doc_id"), F.inline(F.filter(F.array(first, F.when(e % 5 != 0, second)), lambda f: f.isNotNull())))
    return docs, fields


@query("T8", sql=GROUPED)
def grouped_routing(t):
    return SJ.route_grouped(*documents_and_fields(t.events), "strict")


@query("T8", sql=GROUPED)
def stream_grouped_routing(t):
    """Documents and fields as two streams, closed at their end."""
    marker = marker_folder(t.spark)
    docs, fields = documents_and_fields(read_events(t.spark, t.sf_dir, marker=marker))
    out = run_to_end(SJ.route_grouped(docs, fields, "strict"), "grouped-routing", marker)
    return out.where("doc_id >= 0").drop("batch_id")


VERSIONS = """with v as (select event_id, user_id, ts, case when event_type <> 'error' then event_type end as kind from events),
c as (select user_id as entity_id, event_id, lag(kind) over (partition by user_id order by ts, event_id) as before, kind as after from v)
select entity_id, event_id, case when before is null then 'insert' when after is null then 'delete' else 'update' end as action,
  json_object('before', before, 'after', after)::varchar as meta from c where before is distinct from after"""


def versions_of(events):
    """Versions of a user's entity: its value is the kind of the event, an error deletes it."""
    return events.select(F.col("user_id").alias("entity_id"), "event_id", F.col("ts").alias("event_time"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"))


@query("T9", sql=VERSIONS)
def version_audit(t):
    changes = AU.version_changes(versions_of(t.events))
    return changes.select("entity_id", "event_id", "action", AU.change_meta(F.col("before"), F.col("after")).alias("meta"))


@query("T9", sql=VERSIONS)
def stream_audit_log(t):
    """Changes found by the stream itself, from the last value of each entity."""
    with rocksdb_state(t.spark):
        changes = run_now(CH.version_changes(versions_of(read_events(t.spark, t.sf_dir))), "audit")
    return changes.select("entity_id", "event_id", "action", AU.change_meta(F.col("before"), F.col("after")).alias("meta"))


@query("T9", views="invoice_docs", sql="""
with o as (select doc_id, status, category_id from invoice_docs where doc_id % 13 <> 0),
n as (select doc_id, case when doc_id % 5 = 0 then 'archived' else status end as status, case when doc_id % 7 <> 0 then category_id end as category_id from invoice_docs where doc_id % 17 <> 0),
j as (select coalesce(o.doc_id, n.doc_id) as doc_id, o.doc_id is null as fresh, n.doc_id is null as gone, o.status as s0, n.status as s1, o.category_id as c0, n.category_id as c1
  from o full outer join n on o.doc_id = n.doc_id)
select doc_id, case when fresh then 'insert' when gone then 'delete' else 'update' end as action, s0 is distinct from s1 as status_changed, c0 is distinct from c1 as category_changed
from j where fresh or gone or s0 is distinct from s1 or c0 is distinct from c1""")
def snapshot_audit(t):
    """Two snapshots of the documents: some new, some gone, some archived, some without their category."""
    d, k = t.invoice_docs.select("doc_id", "status", "category_id"), F.col("doc_id")
    after = d.where(k % 17 != 0).select(
        "doc_id", F.when(k % 5 == 0, "archived").otherwise(F.col("status")).alias("status"), F.when(k % 7 != 0, F.col("category_id")).alias("category_id"))
    found = AU.snapshot_changes(d.where(k % 13 != 0), after, ["doc_id"], ["status", "category_id"])
    meta = F.col("meta")
    return found.select("doc_id", "action", meta.contains('"status":').alias("status_changed"), meta.contains('"category_id":').alias("category_changed"))
