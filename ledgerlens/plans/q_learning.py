"""Accuracy, corrections and training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import corrections as C
from ledgerlens.operators.documents import page_of
from ledgerlens.operators import learning as L
from ledgerlens.plans.registry import query

REPORT = """
select field_name, count(*) as total_extractions, count(*) filter (where is_corrected) as corrected_count,
  (count(*) - count(*) filter (where is_corrected)) / count(*) as accuracy, cast(sum(confidence) as double) / count(*) as avg_confidence,
  cast(sum(confidence) as double) / count(*) - (count(*) - count(*) filter (where is_corrected)) / count(*) as calibration_error
from extracted_fields {where} group by field_name"""


@query("A5", views="extracted_fields", sql=REPORT.format(where="where created_at >= timestamp '1996-01-01'"))
def field_accuracy(t):
    return L.field_accuracy(t.extracted_fields, "1996-01-01")


@query("A6", views="extracted_fields", sql=f"""
select field_name, total_extractions from ({REPORT.format(where='')}) where calibration_error > -0.3 and total_extractions > 10""")
def over_confident_fields(t):
    return L.over_confident(L.field_accuracy(t.extracted_fields), error=-0.3).select("field_name", "total_extractions")


@query("A7", views="extracted_fields", sql=f"""
select least(0.95, 0.7 + 0.05 * count(*) filter (where calibration_error > -0.3))::double as extraction_threshold,
  count(*) filter (where calibration_error > -0.3) as raised_by, count(*) as fields_analyzed from ({REPORT.format(where='')})""")
def calibrated_threshold(t):
    return L.calibrated_threshold(L.field_accuracy(t.extracted_fields), error=-0.3)


SURE = REPORT.format(where="where confidence >= 0.97")


@query("A6", views="extracted_fields", sql=f"""
select field_name, total_extractions, concat('Field ''', field_name, ''' is over-confident: confidence ', printf('%.2f', avg_confidence), ' against accuracy ', printf('%.2f', accuracy),
  '. Consider stricter validation.') as suggestion from ({SURE}) where calibration_error > 0.3::double and total_extractions > 10""")
def over_confident_sure_fields(t):
    """Fields that were sure, at the default limit."""
    return L.over_confident(L.field_accuracy(t.extracted_fields.where("confidence >= 0.97")))


@query("A7", views="extracted_fields", sql=f"""
select least(0.95, 0.7 + 0.05 * count(*) filter (where calibration_error > 0.2::double))::double as extraction_threshold,
  count(*) filter (where calibration_error > 0.2::double) as raised_by, count(*) as fields_analyzed from ({SURE})""")
def calibrated_threshold_sure_fields(t):
    return L.calibrated_threshold(L.field_accuracy(t.extracted_fields.where("confidence >= 0.97")))


SETS = """with s as (select doc_id, string_agg(field_name, ',' order by field_name) as fields from (
  select distinct doc_id, field_name from sparse_fields) group by doc_id)"""


@query("A8", views="sparse_fields", sql=SETS + """
select fields, count(*) as evidence_count from s group by fields
having count(*) >= 3 and fields <> 'invoice_number,vendor_name'""")
def template_suggestions(t):
    known = t.spark.range(1).select(F.array(F.lit("vendor_name"), F.lit("invoice_number")).alias("fields"))
    return L.template_suggestions(t.sparse_fields, known).select(F.array_join("fields", ",").alias("fields"), "evidence_count")


@query("U5", views="sparse_fields", sql="""
with s as (select distinct doc_id, field_name from sparse_fields)
select doc_id, count(*) filter (where field_name in ('invoice_number', 'total_amount', 'tax_id')) as shared,
  3 - count(*) filter (where field_name in ('invoice_number', 'total_amount', 'tax_id')) as missing,
  count(*) filter (where field_name not in ('invoice_number', 'total_amount', 'tax_id')) as extra, false as same_set
from s group by doc_id""")
def field_set_overlap(t):
    return L.field_overlap(t.sparse_fields, ["invoice_number", "total_amount", "tax_id"])


ENRICHED = """with e as (select c.*, f.doc_id, f.field_name, f.page_number, f.confidence, d.type as document_type,
  coalesce(u.email, 'unknown') as email,
  case when original_value is null and corrected_value is not null then 'value_added'
    when original_value is not null and corrected_value is null then 'value_cleared' else 'value_change' end as kind
  from field_corrections c join extracted_fields f on f.field_id = c.field_id join invoice_docs d on d.doc_id = f.doc_id
  left join users u on u.user_id = c.user_id)"""
VIEWS = "field_corrections users"


def enriched(t):
    return C.enrich(t.field_corrections, t.extracted_fields, t.invoice_docs, t.users)


@query("J14 X45", views=VIEWS, sql=ENRICHED + """
select correction_id, field_name, document_type, email, correction_reason, kind from e""")
def enriched_corrections(t):
    kind = C.correction_type(F.col("original_value"), F.col("corrected_value"))
    return enriched(t).select("correction_id", "field_name", "document_type", "email", "correction_reason", kind.alias("kind"))


@query("P7", views=VIEWS, sql=ENRICHED + """
select correction_id, field_id, user_id from e where field_name in ('subtotal', 'vat', 'total_amount')
  and correction_reason in ('ocr_error', 'format_error') and feedback_sentiment is not null
  and corrected_at >= timestamp '2024-01-03' and corrected_at <= timestamp '2024-01-25'""")
def filtered_corrections(t):
    return C.filter_corrections(
        enriched(t), field_names=["subtotal", "vat", "total_amount"], reasons=["ocr_error", "format_error"],
        start="2024-01-03", end="2024-01-25", has_feedback=True).select("correction_id", "field_id", "user_id")


LATEST = """with l as (select * from (select *, row_number() over (partition by field_id order by corrected_at desc, correction_id desc) as rn
  from field_corrections) where rn = 1)"""


@query("W1", views="field_corrections", sql=LATEST + """
select field_id, correction_id, corrected_value, cast(corrected_at as varchar) as corrected_at from l""")
def latest_corrections(t):
    return C.latest_corrections(t.field_corrections).select("field_id", "correction_id", "corrected_value", "corrected_at")


@query("J18 X46", views="field_corrections", sql=LATEST + """
select f.field_id, f.doc_id, f.field_name, case when l.field_id is null then f.field_value else l.corrected_value end as value,
  cast(case when l.field_id is null then f.confidence else greatest(0, least(1, f.confidence + l.confidence_adjustment)) end as double) as confidence,
  case when l.field_id is null then 'extracted' else 'corrected' end as source
from extracted_fields f left join l on l.field_id = f.field_id""")
def effective_values(t):
    return C.effective_values(t.extracted_fields, t.field_corrections)


REQUESTS = """, r as (select event_id as request_id, event_id - event_id % 4 as doc_id,
  case event_id // 4 % 4 when 0 then 'total_amount' when 1 then 'vat' when 2 then 'vendor_name' else 'tax_id' end as field_name,
  case when event_id % 9 <> 0 then concat('v', cast(event_id as varchar)) end as corrected_value,
  cast((event_id * 7 % 41 - 20) * 0.03 as decimal(5,4)) as adj from events)"""


def batch(t):
    e = F.col("event_id")
    turn = F.floor(e / 4) % 4
    name = F.when(turn == 0, "total_amount").when(turn == 1, "vat").when(turn == 2, "vendor_name").otherwise("tax_id")
    requests = t.events.select(
        e.alias("request_id"), (e - e % 4).alias("doc_id"), name.alias("field_name"),
        F.when(e % 9 != 0, F.concat(F.lit("v"), e.cast("string"))).alias("corrected_value"),
        ((e * 7 % 41 - 20) * F.expr("0.03")).cast("decimal(5,4)").alias("confidence_adjustment"))
    return C.apply_batch(t.extracted_fields, requests, block=3)


@query("J19 X46", views="extracted_fields", sql="with x as (select 1)" + REQUESTS + """
, g as (select doc_id, field_name, arg_max(row(corrected_value), request_id) as w, list(adj order by request_id) as adjs from r group by all)
select f.field_id, case when g.w is null then f.field_value else g.w[1] end as field_value,
  cast(case when g.w is null then f.confidence else list_reduce(list_prepend(cast(f.confidence as decimal(18,4)), list_transform(g.adjs, lambda x: cast(x as decimal(18,4)))),
    lambda a, x: case when x = 0 then a else greatest(cast(0 as decimal(18,4)), least(cast(1 as decimal(18,4)), cast(a + x as decimal(18,4)))) end) end as double) as confidence,
  f.is_edited or g.w is not null as is_edited
from extracted_fields f left join g on g.doc_id = f.doc_id and g.field_name = f.field_name""")
def batch_corrections(t):
    return batch(t)[0].select("field_id", "field_value", "confidence", "is_edited")


@query("J19 X46", views="extracted_fields", sql="with x as (select 1)" + REQUESTS + """
, k as (select r.*, f.field_id, f.field_value, row_number() over w as turn, lag(r.corrected_value) over w as before
  from r join extracted_fields f on r.doc_id = f.doc_id and r.field_name = f.field_name window w as (partition by f.field_id order by request_id)),
o as (select request_id, field_id, corrected_value, case when turn = 1 then field_value else before end as original_value from k)
select *, case when original_value is null and corrected_value is not null then 'value_added' when original_value is not null and corrected_value is null then 'value_cleared'
  else 'value_change' end as correction_type from o""")
def batch_correction_records(t):
    return batch(t)[1].select("request_id", "field_id", "corrected_value", "original_value", "correction_type")


@query("J19", views="extracted_fields", sql="with x as (select 1)" + REQUESTS + """
select request_id, doc_id, field_name, concat('Field ''', field_name, ''' not found') as message from r
where not exists (select 1 from extracted_fields f where f.doc_id = r.doc_id and f.field_name = r.field_name)""")
def batch_correction_errors(t):
    return batch(t)[2]


@query("A9", views="field_corrections", sql="""
select f.doc_id, count(distinct f.field_id) as total_fields, count(distinct c.field_id) as corrected_fields,
  count(c.correction_id) as total_corrections, count(*) filter (where c.is_critical) as critical_count,
  count(c.feedback_sentiment) as feedback_count, cast(min(c.corrected_at) as varchar) as first_at, cast(max(c.corrected_at) as varchar) as last_at,
  count(distinct c.field_id) / count(distinct f.field_id) * 100 as correction_rate,
  count(*) filter (where c.is_critical) > 0 or count(c.correction_id) > 5 as requires_review,
  count(*) filter (where c.is_critical) > 0 or count(c.correction_id) > 5 or count(distinct c.field_id) / count(distinct f.field_id) * 100 > 50 as requires_review_by_rate
from extracted_fields f left join field_corrections c on c.field_id = f.field_id group by f.doc_id""")
def document_correction_summary(t):
    return C.document_summary(t.extracted_fields, t.field_corrections)


@query("A9 X45", views=VIEWS, sql=ENRICHED + """
select doc_id, 'reason' as dimension, correction_reason as value, count(*) as corrections from e group by all
union all select doc_id, 'type', kind, count(*) from e group by all
union all select doc_id, 'feedback', feedback_sentiment, count(*) from e where feedback_sentiment is not null group by all""")
def document_correction_breakdown(t):
    return C.document_breakdown(t.extracted_fields, t.field_corrections)


@query("A10", views=VIEWS, sql=ENRICHED + """
select count(*) as total_corrections, count(distinct field_id) as corrected_fields, count(distinct doc_id) as documents,
  count(distinct email) as users, count(feedback_sentiment) as with_feedback,
  count(*) / greatest(1, count(distinct doc_id)) as avg_per_document, count(feedback_sentiment) / greatest(1, count(*)) as feedback_coverage
from e where corrected_at >= timestamp '2024-01-10'""")
def correction_statistics(t):
    return C.statistics(enriched(t), "2024-01-10")


@query("A10", views=VIEWS, sql=ENRICHED + """, p as (select * from e where corrected_at >= timestamp '2024-01-10')
select 'reason' as dimension, correction_reason as value, count(*) as corrections from p group by all
union all select 'type', kind, count(*) from p group by all
union all select 'user', email, count(*) from p group by all
union all select 'feedback', coalesce(feedback_sentiment, 'none'), count(*) from p group by all""")
def correction_statistics_by(t):
    return C.statistics_by(enriched(t), "2024-01-10")


@query("A11 T4", views="field_corrections", sql="""
select cast(cast(corrected_at as date) as varchar) as day, correction_reason, count(*) as corrections, count(*) filter (where is_critical) as critical
from field_corrections group by all""")
def daily_corrections(t):
    return C.daily_corrections(t.field_corrections)


@query("T5 A11", views="field_corrections", sql="""
select cast(w.d as varchar) as window_start, cast(w.d + 7 as varchar) as window_end, count(*) as corrections
from field_corrections c join (select cast(unnest(generate_series(date '2023-12-01', date '2024-03-01', interval 1 day)) as date) as d) w
  on cast(c.corrected_at as date) >= w.d and cast(c.corrected_at as date) < w.d + 7 group by w.d""")
def moving_corrections(t):
    return C.moving_daily(t.field_corrections)


@query("A11", views="field_corrections", sql="""
select d.type, f.field_name, count(*) as fields, count(h.field_id) as corrected, count(h.field_id) / count(*) as rate
from extracted_fields f join invoice_docs d on d.doc_id = f.doc_id
left join (select distinct field_id from field_corrections) h on h.field_id = f.field_id group by all""")
def correction_rate_by_field(t):
    return C.correction_rate(t.extracted_fields, t.invoice_docs, t.field_corrections)


@query("A12", views=VIEWS, sql=ENRICHED + """
select coalesce(correction_reason, '*') as correction_reason, coalesce(field_name, '*') as field_name, count(*) as corrections,
  cast(sum(confidence_adjustment) as double) / count(*) as avg_adjustment, count(*) filter (where is_critical) / count(*) as critical_rate
from e group by rollup (correction_reason, field_name)""")
def correction_analytics(t):
    a = C.analytics(enriched(t), ["correction_reason", "field_name"]).drop("level")
    return a.na.fill("*", ["correction_reason", "field_name"])


SESSIONS = """with s as (select c.*, f.doc_id, case when lag(c.corrected_at) over w is null or c.corrected_at - lag(c.corrected_at) over w >= interval 30 minute then 1 else 0 end as new
  from field_corrections c join extracted_fields f on f.field_id = c.field_id
  window w as (partition by c.user_id order by c.corrected_at, c.correction_id)),
n as (select *, cast(sum(new) over (partition by user_id order by corrected_at, correction_id) as bigint) as session_no from s)"""


@query("W8 T6", views="field_corrections", sql=SESSIONS + " select correction_id, user_id, session_no from n")
def correction_sessions(t):
    return C.sessions(t.field_corrections, t.extracted_fields).select("correction_id", "user_id", "session_no")


@query("A13", views="field_corrections", sql=SESSIONS + """
select user_id, session_no, count(*) as total_corrections, count(distinct field_id) as fields_corrected, count(distinct doc_id) as documents,
  count(*) filter (where is_critical) as critical, count(feedback_sentiment) as feedback, cast(min(corrected_at) as varchar) as started_at,
  cast(max(corrected_at) as varchar) as completed_at, (epoch_us(max(corrected_at)) - epoch_us(min(corrected_at))) / 60000000.0::double as duration_minutes
from n group by user_id, session_no""")
def correction_session_audit(t):
    return C.session_audit(C.sessions(t.field_corrections, t.extracted_fields))


@query("W8", views="field_corrections", sql="""
select correction_id, field_id, row_number() over (partition by field_id order by corrected_at, correction_id) as version from field_corrections""")
def correction_versions(t):
    return C.versions(t.field_corrections).select("correction_id", "field_id", "version")


@query("A26 A27", views="field_corrections", sql="""
select f.field_id, f.field_name, f.field_value as original_value,
  case when count(c.correction_id) = 0 then f.field_value else arg_max_null(c.corrected_value, (c.corrected_at, c.correction_id)) end as current_value,
  count(c.correction_id) as correction_count, count(distinct c.user_id) as users, count(c.feedback_sentiment) as feedback_collected,
  cast(max(c.corrected_at) as varchar) as last_correction_at,
  case when count(*) filter (where c.is_critical) > 0 then 'critical' when count(c.correction_id) > 2 then 'high' when count(c.correction_id) > 0 then 'medium' else 'none' end as severity
from extracted_fields f left join field_corrections c on c.field_id = f.field_id group by f.field_id, f.field_name, f.field_value""")
def correction_history(t):
    return C.history_fold(t.extracted_fields, t.field_corrections)


@query("A26", views="field_corrections", sql="select field_id, user_id, count(*) as corrections from field_corrections group by all")
def correction_history_by_user(t):
    return C.history_by_user(t.field_corrections)


@query("W9 X34", views="field_corrections", sql="""
select c.correction_id, c.field_id, row_number() over w as step,
  cast(greatest(0, f.confidence - 0.15 * cast(count(*) filter (where c.is_critical) over w as integer)) as double) as confidence
from field_corrections c join extracted_fields f on f.field_id = c.field_id
window w as (partition by c.field_id order by c.corrected_at, c.correction_id rows unbounded preceding)""")
def confidence_history(t):
    return C.confidence_history(t.extracted_fields, t.field_corrections)


@query("S11", views=VIEWS, sql=ENRICHED + """
select correction_id, doc_id, document_type, page_number, field_name, original_value as extracted_value, cast(confidence as double) as extraction_confidence,
  corrected_value, correction_reason, original_value is not distinct from corrected_value as was_correct, feedback_sentiment
from e where corrected_at >= timestamp '2024-01-05' and correction_reason in ('ocr_error', 'extraction_error') and feedback_sentiment in ('good', 'excellent')""")
def training_records(t):
    e = C.filter_corrections(enriched(t), start="2024-01-05", reasons=["ocr_error", "extraction_error"], min_sentiment="good")
    return C.training_records(e)


@query("S11", views=VIEWS, sql=ENRICHED + """
select count(*) as record_count, count(distinct doc_id) as documents_included, count(distinct correction_reason) as reasons_included,
  count(feedback_sentiment) as feedback_records from e""")
def training_summary(t):
    return C.training_summary(C.training_records(enriched(t)))


ANALYTICS = """
select cast({key} as varchar) as "group", count(*) as corrections, cast(sum(confidence) as double) / count(confidence) as avg_confidence,
  count(*) filter (where is_critical) / count(*) as critical_rate from e group by 1"""


@query("A13", views=VIEWS, sql=ENRICHED + ANALYTICS.format(key="user_id"))
def correction_analytics_by_user(t):
    return C.correction_analytics(enriched(t), "user")


@query("A13", views=VIEWS, sql=ENRICHED + ANALYTICS.format(key="cast(corrected_at as date)"))
def correction_analytics_by_date(t):
    return C.correction_analytics(enriched(t), "date")


@query("P7 L1", views=VIEWS, sql=ENRICHED + """
select correction_id, field_name from e where correction_id % 3 = 0 and coalesce(correction_id % 2 = 0, false) order by corrected_at desc, correction_id desc limit 700 offset 20""")
def verified_corrections_page(t):
    """A page of the verified corrections; every third correction was looked at, every second of those held."""
    verified = F.when(F.col("correction_id") % 3 == 0, F.col("correction_id") % 2 == 0)
    found = C.filter_corrections(enriched(t).withColumn("is_verified", verified), is_verified=True)
    return page_of(found, [F.col("corrected_at").desc(), F.col("correction_id").desc()], 700, 20).select("correction_id", "field_name")
