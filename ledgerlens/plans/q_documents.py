"""Lists, filters, joins, set operations and counts of the document store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.text import parse_bound
from ledgerlens.operators import documents as D
from ledgerlens.plans.registry import query

NOW = "2001-07-31"


@query("S1 P1", views="invoice_docs", sql="""
select doc_id, name, type, status, cast(created_at as varchar) as created_at from invoice_docs
where status = 'completed' and type = 'invoice' and lower(name) like '%doc-1%'
  and created_at >= timestamp '1996-01-01' and created_at <= timestamp '1999-12-31 23:59:59.999999'""")
def list_documents(t):
    d = D.filter_documents(t.invoice_docs, status="completed", doc_type="invoice", name="doc-1",
                           created_from="1996-01-01", created_to="1999-12-31")
    return d.select("doc_id", "name", "type", "status", "created_at")


@query("P1", views="invoice_docs", sql="""
select user_id, count(*) as documents from invoice_docs group by user_id""")
def documents_per_owner(t):
    return t.invoice_docs.groupBy("user_id").agg(F.count("*").alias("documents"))


@query("P2", views="invoice_docs", sql="""
select doc_id, cast(confidence as double) as confidence from invoice_docs where confidence >= 0.25 and confidence <= 0.75""")
def confidence_range(t):
    return D.filter_documents(t.invoice_docs, confidence_min=0.25, confidence_max=0.75).select("doc_id", "confidence")


@query("P3", views="invoice_docs", sql="""
select count(*) filter (where created_at >= timestamp '1997-03-01') as from_day,
  count(*) filter (where created_at <= timestamp '1997-03-01 23:59:59.999999') as to_day,
  count(*) filter (where created_at >= timestamp '1997-03-01 12:30:00') as from_time, count(*) as unreadable
from invoice_docs""")
def date_bounds(t):
    c = F.col("created_at")
    bad = parse_bound("no date here")
    return t.invoice_docs.agg(
        F.count_if(c >= parse_bound("1997-03-01")).alias("from_day"),
        F.count_if(c <= parse_bound("1997-03-01", True)).alias("to_day"),
        F.count_if(c >= parse_bound("1997-03-01T12:30:00")).alias("from_time"),
        F.count_if(bad.isNull() | (c >= bad)).alias("unreadable"))


@query("P4", views="invoice_docs", sql="select doc_id, name, type from invoice_docs where status = 'needs_review'")
def review_queue(t):
    return D.filter_documents(t.invoice_docs, status="needs_review").select("doc_id", "name", "type")


@query("P5 L1", views="audit_logs", sql="""
select id, action, document_id, cast(created_at as varchar) as created_at from (
  select * from audit_logs where actor_user_id = 8 and entity_type = 'document' and created_at >= timestamp '2024-01-05'
  order by created_at desc, id desc limit 100 offset 5)""")
def audit_log_page(t):
    logs = D.filter_audit_logs(t.audit_logs, False, 8, entity_type="document", created_from="2024-01-05")
    return D.page_of(logs, D.newest_first("id"), 100, 5).select("id", "action", "document_id", "created_at")


@query("X50", views="audit_logs", sql="""
select action, cast(sum(cast(json_extract_string(meta, '$.k') as bigint)) as bigint) as k_sum, count(*) as events
from audit_logs group by action""")
def audit_meta_property(t):
    k = F.get_json_object("meta", "$.k").try_cast("long")
    return t.audit_logs.groupBy("action").agg(F.sum(k).alias("k_sum"), F.count("*").alias("events"))


STATES = """with s as (select * from (select *, row_number() over (partition by job_id order by event_time desc, event_id desc) as rn
  from job_events) where rn = 1)"""


@query("W2", views="job_events", sql=STATES + """
select job_id, document_id, provider, status, cast(event_time as varchar) as event_time from s""")
def latest_job_states(t):
    return D.latest_job_states(t.job_events)


@query("P6 J2", views="job_events invoice_docs", sql=STATES + """
select s.job_id, s.provider, s.status, d.name as document_name, d.type as document_type, d.status as document_status
from s join invoice_docs d on d.doc_id = s.document_id where s.status in ('triggered', 'running')""")
def active_jobs(t):
    j = D.active_jobs(D.latest_job_states(t.job_events), t.invoice_docs)
    return j.select("job_id", "provider", "status", "document_name", "document_type", "document_status")


@query("P6 J2", views="job_events invoice_docs", sql=STATES + """
select s.provider, s.status, d.type as document_type, count(*) as jobs
from s join invoice_docs d on d.doc_id = s.document_id where s.status in ('completed', 'error', 'cancelled') group by all""")
def job_history(t):
    j = D.job_history(D.latest_job_states(t.job_events), t.invoice_docs)
    return j.groupBy("provider", "status", "document_type").agg(F.count("*").alias("jobs"))


@query("A22 T10", views="job_events", sql=STATES + " select status, count(*) as jobs from s group by status")
def job_backlog(t):
    return D.job_backlog(D.latest_job_states(t.job_events))


@query("J16", views="job_events", sql="""
select document_id, job_id, event_id as result_event_id, cast(event_time as varchar) as completed_at from (
  select *, row_number() over (partition by document_id order by event_time desc, event_id desc) as rn
  from job_events where status = 'completed') where rn = 1""")
def latest_completed_result(t):
    return D.latest_completed_result(t.job_events)


@query("J17", views="job_events", sql=STATES + """
, c as (select job_id from s where provider = 'external')
select distinct document_id from s where job_id in (select job_id from c) and document_id not in (
  select document_id from s where status in ('pending', 'triggered', 'running') and job_id not in (select job_id from c))""")
def idle_after_cancel(t):
    s = D.latest_job_states(t.job_events)
    return D.documents_idle_after_cancel(s, s.where(F.col("provider") == "external").select("job_id"))


@query("J1", views="invoice_docs extracted_fields doc_pages", sql="""
select d.doc_id, d.name, d.type, d.status, x.page_number, x.part, x.field_id, x.field_name, x.field_value
from invoice_docs d join (
  select doc_id, page_number, 'page' as part, cast(-1 as bigint) as field_id, null as field_name, null as field_value from doc_pages
  union all select doc_id, page_number, 'field', field_id, field_name, field_value from extracted_fields) x on x.doc_id = d.doc_id""")
def document_details(t):
    return D.document_details(t.invoice_docs, t.extracted_fields, t.doc_pages).withColumn(
        "field_id", F.coalesce("field_id", F.lit(-1)))


@query("S12", views="invoice_docs extracted_fields doc_pages", sql="""
select d.doc_id, d.type, f.field_count, f.manual_fields, f.first_field, f.last_field, p.page_count, p.last_page
from invoice_docs d
join (select doc_id, count(*) as field_count, count(*) filter (where is_edited) as manual_fields,
        min_by(field_name, field_id) as first_field, max_by(field_name, field_id) as last_field from extracted_fields group by doc_id) f
  on f.doc_id = d.doc_id
join (select doc_id, count(*) as page_count, max(page_number) as last_page from doc_pages group by doc_id) p on p.doc_id = d.doc_id""")
def assembled_sizes(t):
    return D.assembled_sizes(t.invoice_docs, t.extracted_fields, t.doc_pages)


@query("S12 P11", views="invoice_docs extracted_fields doc_pages job_events", sql="""
select d.doc_id, d.type, 0 as part, f.header_fields, 0 as item_fields, p.pages, coalesce(r.result_event_id, -1) as result_event_id
from invoice_docs d
join (select doc_id, string_agg(field_name, ',' order by field_id) as header_fields from extracted_fields group by doc_id) f on f.doc_id = d.doc_id
join (select doc_id, string_agg(cast(page_number as varchar), ',' order by page_number) as pages from doc_pages group by doc_id) p on p.doc_id = d.doc_id
left join (select document_id, max_by(event_id, (event_time, event_id)) as result_event_id from job_events where status = 'completed' group by document_id) r
  on r.document_id = d.doc_id""")
def assembled_documents(t):
    a = D.assemble(t.invoice_docs, t.extracted_fields, t.doc_pages, D.latest_completed_result(t.job_events))
    return a.select(
        "doc_id", "type", "part", F.array_join("header_fields.field_name", ",").alias("header_fields"),
        F.size("item_fields").alias("item_fields"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
        F.coalesce("result_event_id", F.lit(-1)).alias("result_event_id"))


@query("A1", views="invoice_docs", sql="""
select 'total' as dimension, null as value, count(*) as documents from invoice_docs
union all select 'status', status, count(*) from invoice_docs group by status
union all select 'type', type, count(*) from invoice_docs group by type""")
def document_stats(t):
    return D.document_stats(t.invoice_docs)


@query("A2", views="invoice_docs", sql=f"""
select cast(cast(g.d as date) as varchar) as day, count(doc_id) as documents
from range(date '{NOW}' - interval 99 day, date '{NOW}' + interval 1 day, interval 1 day) g(d)
left join invoice_docs on cast(created_at as date) = cast(g.d as date) group by 1""")
def daily_documents(t):
    return D.daily_counts(t.invoice_docs, NOW, 100)


@query("A3", views="invoice_docs", sql="""
select n_nationkey as category_id, n_name as name, count(doc_id) as documents
from nation left join invoice_docs on category_id = n_nationkey group by all""")
def category_counts(t):
    dim = t.nation.select(F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("name"))
    return D.dimension_counts(dim, t.invoice_docs.select("category_id"), "category_id", "documents")


@query("A4", sql="""
select s_suppkey as tag_id, s_name as name, count(event_id) as documents
from supplier left join events on cast(json_extract_string(props, '$.k') as bigint) = s_suppkey group by all""")
def tag_counts(t):
    dim = t.supplier.select(F.col("s_suppkey").alias("tag_id"), F.col("s_name").alias("name"))
    bridge = t.events.select(F.get_json_object("props", "$.k").try_cast("long").alias("tag_id"))
    return D.dimension_counts(dim, bridge, "tag_id", "documents")


@query("L1", views="invoice_docs", sql="""
select doc_id, name, cast(created_at as varchar) as created_at, (select count(*) from invoice_docs) as total
from (select * from invoice_docs order by created_at desc, doc_id desc limit 1000 offset 40)""")
def document_page(t):
    total = t.invoice_docs.agg(F.count("*"))
    page = D.page_of(t.invoice_docs, D.newest_first(), limit=1000, offset=40)
    return page.select("doc_id", "name", "created_at").withColumn("total", total.scalar())


@query("L2", views="invoice_docs", sql="""
select doc_id, cast(confidence as double) as confidence from invoice_docs order by confidence desc, doc_id limit 200""")
def sorted_documents(t):
    return D.sort_by(t.invoice_docs, "confidence", descending=True).limit(200).select("doc_id", "confidence")


@query("L3", views="invoice_docs", sql="""
select doc_id, name, cast(created_at as varchar) as created_at from invoice_docs order by created_at desc, doc_id desc limit 10""")
def recent_documents(t):
    return D.page_of(t.invoice_docs, D.newest_first(), 10).select("doc_id", "name", "created_at")


@query("J3", views="invoice_docs match_links", sql="""
select doc_id, name, type from invoice_docs where doc_id not in (select document_id from match_links)""")
def unmatched_documents(t):
    return D.unmatched(t.invoice_docs, t.match_links).select("doc_id", "name", "type")


@query("J4", views="invoice_docs match_links", sql="""
select l.set_id, l.document_id, d.name, d.type, count(*) over (partition by l.set_id) as members
from match_links l join invoice_docs d on d.doc_id = l.document_id""")
def match_sets(t):
    return D.match_sets(t.match_links, t.invoice_docs).select("set_id", "document_id", "name", "type", "members")


@query("J8", views="invoice_docs match_links", sql="""
select r.set_id, r.document_id, l.set_id as other_set
from (select doc_id - doc_id % 3 as set_id, doc_id as document_id from invoice_docs) r
join match_links l on l.document_id = r.document_id and l.set_id <> r.set_id""")
def membership_conflicts(t):
    d = F.col("doc_id")
    requested = t.invoice_docs.select((d - d % 3).alias("set_id"), d.alias("document_id"))
    return D.membership_conflicts(requested, t.match_links)


@query("U4", views="invoice_docs", sql="""
select o_orderkey as doc_id from orders where o_orderkey not in (select doc_id from invoice_docs)""")
def invalid_ids(t):
    return D.invalid_ids(t.orders.select(F.col("o_orderkey").alias("doc_id")), t.invoice_docs, "doc_id")


@query("U1", sql="select user_id, min(event_id) as event_id from events group by user_id")
def ordered_distinct_users(t):
    return D.ordered_distinct(t.events, "user_id", "event_id")


@query("U3", views="invoice_docs match_links", sql="""
with r as (select distinct doc_id - doc_id % 8 as set_id, doc_id as document_id from invoice_docs where type = 'receipt')
select set_id, document_id from match_links where set_id not in (select set_id from r) union all select set_id, document_id from r""")
def replaced_links(t):
    d = F.col("doc_id")
    new = t.invoice_docs.where(F.col("type") == "receipt").select((d - d % 8).alias("set_id"), d.alias("document_id"))
    return D.replace_links(t.match_links, new, "set_id")


@query("J20", views="invoice_docs extracted_fields doc_pages", sql="""
select 'fields' as child, count(*) as n from extracted_fields where doc_id not in (select doc_id from invoice_docs where status = 'needs_review')
union all select 'pages', count(*) from doc_pages where doc_id not in (select doc_id from invoice_docs where status = 'needs_review')
union all select 'documents', count(*) from invoice_docs where status <> 'needs_review'""")
def cascade_delete(t):
    doomed = t.invoice_docs.where(F.col("status") == "needs_review").select("doc_id")
    left = D.delete_with_cascade(doomed, fields=t.extracted_fields, pages=t.doc_pages, documents=t.invoice_docs)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n") for name, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("J20", views="invoice_docs", sql="""
select doc_id, coalesce(case when n_regionkey = 2 then null else category_id end, -1) as category_id
from invoice_docs left join nation on n_nationkey = category_id""")
def category_delete(t):
    gone = t.nation.where(F.col("n_regionkey") == 2).select(F.col("n_nationkey").cast("long").alias("category_id"))
    d = D.delete_categories(t.invoice_docs, gone)
    return d.select("doc_id", F.coalesce("category_id", F.lit(-1)).alias("category_id"))


@query("J21", views="invoice_docs", sql="""
select d.doc_id, case when l.toxic = 1 then 'error' when l.quality = 1 then 'completed' else d.status end as status,
  case when l.toxic = 1 then 'A reviewer turned the document down' end as error_message,
  case when l.toxic = 1 or l.quality = 1 then 'success' when l.doc_id is not null then 'ignored' end as review_result
from invoice_docs d left join labels l on l.doc_id = d.doc_id""")
def review_actions(t):
    act = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "approve").otherwise("hold")
    out = D.apply_review_actions(t.invoice_docs, t.labels.select("doc_id", act.alias("action")))
    return out.select("doc_id", "status", "error_message", "review_result")


@query("J13 W11", views="invoice_docs extracted_fields", sql="""
with d as (select doc_id, user_id, created_at, case when doc_id % 7 = 0 then 'unknown' else type end as type from invoice_docs),
f as (select doc_id, field_id, field_value from extracted_fields where field_name ilike '%vendor%' and field_value <> '' and doc_id % 5 <> 0),
own as (select d.*, (select arg_min(field_value, field_id) from f where f.doc_id = d.doc_id) as vendor from d),
p as (select a.doc_id, b.doc_id as similar_id, row_number() over (partition by a.doc_id order by b.created_at desc, b.doc_id desc) as rank
  from own a join own b on a.user_id = b.user_id and a.doc_id <> b.doc_id and (a.type = 'unknown' or a.type = b.type) and (a.vendor is null or a.vendor = b.vendor))
select doc_id, rank, similar_id from p where rank <= 5""")
def similar_documents(t):
    docs = t.invoice_docs.withColumn("type", F.when(F.col("doc_id") % 7 == 0, "unknown").otherwise(F.col("type")))
    return D.similar_documents(docs, t.extracted_fields.where("doc_id % 5 <> 0 or not contains(lower(field_name), 'vendor')"), 5)


@query("U3", views="invoice_docs match_links", sql="""
with r as (select distinct doc_id - doc_id % 8 as set_id, doc_id + case when doc_id % 24 = 1 then 90000000 else 0 end as document_id from invoice_docs where type = 'receipt'),
ok as (select * from r where set_id not in (select set_id from r where document_id not in (select doc_id from invoice_docs)))
select set_id, document_id from match_links where set_id not in (select set_id from ok) union all select set_id, document_id from ok""")
def checked_link_replacement(t):
    """Requests for sets with an unknown document are refused as a whole."""
    d = F.col("doc_id")
    wrong = F.when(d % 24 == 1, 90000000).otherwise(0)
    new = t.invoice_docs.where(F.col("type") == "receipt").select((d - d % 8).alias("set_id"), (d + wrong).alias("document_id"))
    known = t.invoice_docs.select(d.alias("document_id"))
    return D.replace_valid_links(t.match_links, new, "set_id", "document_id", known)


@query("J21", views="extracted_fields", sql="""
with a as (select doc_id, case when toxic = 1 then 'reject' when quality = 1 then 'approve' else 'hold' end as action from labels),
c as (select event_id as doc_id, case event_id % 3 when 0 then 'vat' when 1 then 'total_amount' else 'no such field' end as field_name,
  case when event_id % 5 <> 0 then concat('c', cast(event_id as varchar)) end as value from events)
select f.field_id, case when c.doc_id is null or a.doc_id is null then f.field_value else c.value end as field_value, f.is_corrected or (c.doc_id is not null and a.doc_id is not null) as is_corrected
from extracted_fields f left join c on c.doc_id = f.doc_id and c.field_name = f.field_name left join a on a.doc_id = f.doc_id and a.action = 'approve'""")
def review_corrections(t):
    """Field values that came with an approval."""
    act = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "approve").otherwise("hold")
    e = F.col("event_id")
    given = t.events.select(
        e.alias("doc_id"), F.when(e % 3 == 0, "vat").when(e % 3 == 1, "total_amount").otherwise("no such field").alias("field_name"),
        F.when(e % 5 != 0, F.concat(F.lit("c"), e.cast("string"))).alias("value"))
    out = D.apply_review_corrections(t.extracted_fields, t.labels.select("doc_id", act.alias("action")), given)
    return out.select("field_id", "field_value", "is_corrected")
