"""Normalization, validation and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import confidence as CF
from ledgerlens.functions import normalize as N
from ledgerlens.operators import routing as R
from ledgerlens.operators import validation as V
from ledgerlens.plans.registry import query

TODAY = "2001-01-15"

DATES = r"""dt as (select value_id, kind, field_value, replace(translate(field_value, '๐๑๒๓๔๕๖๗๘๙', '0123456789'), 'กุมภาพันธ์', '2') as t from raw_values where kind = 'date'),
dp as (select *, regexp_extract(t, '(\d{1,2})[/\-\s]+(\d{1,2})[/\-\s]+(\d{4})', ['a', 'b', 'c']) as p1,
  regexp_extract(t, '(\d{4})[/\-\s]+(\d{1,2})[/\-\s]+(\d{1,2})', ['a', 'b', 'c']) as p2,
  regexp_extract(t, '(?:^|\D)(\d{1,2})[/\-\s]+(\d{1,2})[/\-\s]+(\d{2})(?:\D|$)', ['a', 'b', 'c']) as p3 from dt),
dy as (select *, try_cast(concat_ws('-', case when try_cast(p1.c as int) >= 2400 then try_cast(p1.c as int) - 543 when try_cast(p1.c as int) > 1900 then try_cast(p1.c as int) end, lpad(p1.b, 2, '0'), lpad(p1.a, 2, '0')) as date) as d1,
  try_cast(concat_ws('-', p2.a, lpad(p2.b, 2, '0'), lpad(p2.c, 2, '0')) as date) as d2,
  try_cast(concat_ws('-', 2000 + try_cast(p3.c as int), lpad(p3.b, 2, '0'), lpad(p3.a, 2, '0')) as date) as d3 from dp),
dates as (select value_id, field_value, coalesce(d1, d2, d3) as day,
  case when d1 is not null then 'DD/MM/YYYY' when d2 is not null then 'YYYY/MM/DD' when d3 is not null then 'DD/MM/YY' end as format,
  case when d1 is not null then 0.95 when coalesce(d2, d3) is not null then 0.85 end as conf from dy)"""

AMOUNTS = r"""amt as (select value_id, field_value, translate(field_value, '$€¥₹£฿₽ ', '') as t from raw_values where kind = 'currency'),
ap as (select *, case when contains(t, ',') and contains(t, '.') then
    case when instr(reverse(t), '.') < instr(reverse(t), ',') then replace(t, ',', '') else replace(replace(t, '.', ''), ',', '.') end
  when contains(t, ',') then case when length(regexp_extract(t, '[^,]*$')) = 2 then replace(t, ',', '.') else replace(t, ',', '') end else t end as plain from amt),
amounts as (select value_id, field_value, case when regexp_matches(plain, '^\d+\.?\d*$') then cast(plain as decimal(20,4)) end as amount from ap)"""

TAXES = r"""tt as (select value_id, field_value, regexp_replace(field_value, '\D', '', 'g') as d from raw_values where kind = 'tax_id'),
taxes as (select *, case when length(d) <> 13 then concat('Tax ID must be 13 digits, got ', cast(length(d) as varchar))
  when (11 - list_sum(list_transform(range(1, 13), lambda i: cast(substr(d, cast(i as int), 1) as int) * (14 - i))) % 11) % 10 <> cast(substr(d, 13, 1) as int) then 'Tax ID checksum failed' end as problem from tt)"""


@query("X23 X24", views="raw_values", sql=f"with {DATES} select value_id, cast(day as varchar) as day, format, cast(conf as double) as confidence from dates")
def parsed_dates(t):
    d = t.raw_values.where(F.col("kind") == "date").withColumn("t", N.date_text("field_value"))
    return d.withColumn("d", N.parse_clean_date(F.col("t"))).select(
        "value_id", F.col("d.value").alias("day"), F.col("d.format").alias("format"), F.col("d.confidence").alias("confidence"))


@query("X25", views="raw_values", sql=f"""with {DATES} select value_id, case when day is null then 'Date could not be parsed'
  when day > date '{TODAY}' then concat('Date ', cast(day as varchar), ' is in the future') end as problem from dates""")
def date_problems(t):
    d = t.raw_values.where(F.col("kind") == "date").withColumn("t", N.date_text("field_value")).withColumn("d", N.parse_clean_date(F.col("t")))
    return d.select("value_id", N.date_problem(F.col("d.value"), F.lit(TODAY).cast("date")).alias("problem"))


@query("X26", views="raw_values", sql=f"with {AMOUNTS} select value_id, cast(amount as double) as amount from amounts")
def parsed_amounts(t):
    d = t.raw_values.where(F.col("kind") == "currency").withColumn("t", N.clean_amount("field_value"))
    return d.select("value_id", N.parse_clean_amount(F.col("t")).alias("amount"))


@query("X27", views="raw_values", sql=f"with {TAXES} select value_id, problem from taxes")
def tax_id_problems(t):
    return t.raw_values.where(F.col("kind") == "tax_id").select("value_id", N.tax_id_problem("field_value").alias("problem"))


@query("X28", views="raw_values", sql=r"""select value_id, cast(cast(nullif(regexp_replace(field_value, '\D', '', 'g'), '') as bigint) as varchar) as whole
  from raw_values where kind = 'integer'""")
def integer_values(t):
    return t.raw_values.where(F.col("kind") == "integer").select("value_id", N.integer_text("field_value").alias("whole"))


@query("X32", views="raw_values", sql=f"""with {TAXES}
select kind, count(*) as n, count(*) filter (where ok) as valid from (
  select 'tax_id' as kind, length(d) = 13 as ok from taxes
  union all select 'currency', try_cast(trim(replace(replace(field_value, ',', ''), '$', '')) as decimal(20,4)) is not null from raw_values where kind = 'currency'
  union all select 'date', coalesce(case when regexp_matches(field_value, '^[0-9]{{4}}-') then try_cast(field_value as date) end, try_cast(concat_ws('-', p.c, p.a, p.b) as date), try_cast(concat_ws('-', p.c, p.b, p.a) as date)) is not null
    from (select field_value, regexp_extract(field_value, '^([0-9]+)/([0-9]+)/([0-9]{{4}})$', ['a', 'b', 'c']) as p from raw_values where kind = 'date')) group by kind""")
def plain_validators(t):
    v, k = F.col("field_value"), F.col("kind")
    rows = t.raw_values.where(k.isin("tax_id", "currency", "date"))
    ok = F.when(k == "tax_id", N.plain_tax_id_ok(v)).when(k == "currency", N.plain_amount(v).isNotNull()).otherwise(N.plain_date(v).isNotNull())
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


CHECKS = f"""{DATES}, {AMOUNTS}, {TAXES},
checks as (select value_id, 'date' as kind, case when day is null then field_value else cast(day as varchar) end as normalized_value,
    coalesce(day <= date '{TODAY}', false) as is_valid, case when day is null then 'Could not parse date' when day > date '{TODAY}' then concat('Date ', cast(day as varchar), ' is in the future') end as error_message,
    case when day is null then 0.4 when day > date '{TODAY}' then 0.2 else 1 - conf end::double as adjustment from dates
  union all select value_id, 'currency', case when field_value = '' then null when amount is null then field_value else regexp_replace(cast(amount as varchar), '(\\.\\d+?)0+$', '\\1') end,
    amount is not null, case when field_value = '' then 'Field is empty' when amount is null then 'Could not parse currency' end,
    case when amount is null then 0.3 when amount = 0 then 0.3 else 0.05 end::double from amounts
  union all select value_id, 'tax_id', case when length(d) = 13 then d else field_value end, problem is null, problem, case when problem is null then 0 else 0.3 end::double from taxes
  union all select value_id, 'integer', coalesce(cast(cast(nullif(regexp_replace(field_value, '\\D', '', 'g'), '') as bigint) as varchar), field_value),
    regexp_matches(field_value, '\\d'), case when not regexp_matches(field_value, '\\d') then 'Could not parse as integer' end,
    case when regexp_matches(field_value, '\\d') then 0 else 0.2 end::double from raw_values where kind = 'integer')"""


@query("X31", views="raw_values", sql=f"with {CHECKS} select * from checks")
def field_checks(t):
    return V.check_values(t.raw_values, TODAY).drop("field_value").select(
        "value_id", "kind", "normalized_value", "is_valid", "error_message", "adjustment")


@query("A17", views="raw_values", sql=f"with {CHECKS} select kind, count(*) as total, count(*) filter (where is_valid) as valid, count(*) filter (where not is_valid) as invalid from checks group by kind")
def validation_by_type(t):
    return V.validation_by_type(V.check_values(t.raw_values, TODAY))


# Fields of the documents: amounts and vendor; the report adds the amount relation.
REPORT = """c as (select *, case when field_name in ('subtotal', 'vat', 'total_amount') then case when cast(field_value as decimal(20,4)) = 0 then 0.3 else 0.05 end else 0 end as adj
  from extracted_fields where field_name <> 'invoice_number'),
g as (select doc_id, count(*) as n, sum(adj)::double / count(*) as adjustment,
  max(case when field_name = 'subtotal' then cast(field_value as decimal(20,4)) end) as s, max(case when field_name = 'vat' then cast(field_value as decimal(20,4)) end) as v,
  max(case when field_name = 'total_amount' then cast(field_value as decimal(20,4)) end) as t,
  max(case when field_name = 'subtotal' then confidence end) as sc, max(case when field_name = 'vat' then confidence end) as vc,
  max(case when field_name = 'total_amount' then confidence end) as tc from c group by doc_id),
r as (select *, abs(s + v - t) > 0.05 as mismatch,
  case when sc + vc >= sc + tc and sc + vc >= vc + tc then 'total_amount' when sc + tc >= vc + tc then 'vat' else 'subtotal' end as target,
  case when sc + vc >= sc + tc and sc + vc >= vc + tc then s + v when sc + tc >= vc + tc then t - s else t - v end as guess from g)"""
GUESS = "case when mismatch then regexp_replace(cast(guess as varchar), '(\\.\\d+?)0+$', '\\1') end"


@query("A21 X29 X30", views="extracted_fields", sql=f"""with {REPORT}
select doc_id, n as validation_count, n as valid_count, mismatch::int as invalid_count, mismatch::int as needs_review_count,
  case when mismatch then 'amount_relationship' else '' end as fields_needing_review, adjustment as confidence_adjustment, not mismatch as overall_valid,
  case when mismatch then target end as suggested_field, {GUESS} as suggested_value from r""")
def validation_report(t):
    return V.validation_report(V.checked_fields(t.extracted_fields, TODAY))


@query("A17", views="extracted_fields", sql=f"""with {REPORT}
select count(*) as documents, cast(sum(n) as bigint) as fields, cast(sum(n) as bigint) as valid_fields, cast(sum(mismatch::int) as bigint) as invalid_fields,
  cast(sum(cast(adjustment as decimal(28,8))) as double) / count(*) as mean_adjustment, median(adjustment) as median_adjustment from r""")
def validation_statistics(t):
    return V.validation_statistics(V.validation_report(V.checked_fields(t.extracted_fields, TODAY)))


@query("X29", views="invoice_docs", sql="""
select doc_id, case when abs(s + v - total_amount) > 0.05 then 'Amount mismatch' else '' end || case when v < 0 then case when abs(s + v - total_amount) > 0.05 then ';' else '' end || 'vat should not be negative' else '' end as errors
from (select doc_id, subtotal as s, case when doc_id % 5 = 0 then -vat - 1 else vat end as v, total_amount from invoice_docs)""")
def amount_relations(t):
    a = "decimal(20,4)"
    vat = F.when(F.col("doc_id") % 5 == 0, -F.col("vat") - 1).otherwise(F.col("vat")).cast(a)
    return t.invoice_docs.select("doc_id", F.array_join(
        N.amount_errors(F.col("subtotal").cast(a), vat, F.col("total_amount").cast(a)), ";").alias("errors"))


@query("X35", views="extracted_fields", sql=f"""with {REPORT}
select doc_id, target as field_name, 'logical_inconsistency' as issue_type, 'high' as severity, {GUESS} as suggested_fix from r where mismatch
union all select d.doc_id, 'invoice_number', 'missing_logic', 'medium', null from invoice_docs d where d.type = 'invoice' and d.doc_id % 11 = 0""")
def audit_issues(t):
    gaps = t.sparse_fields.where("field_name = 'invoice_number'").unionByName(t.extracted_fields.where("field_name <> 'invoice_number'"))
    return V.audit_issues(t.invoice_docs, gaps)


@query("P14", views="extracted_fields", sql="""
select d.doc_id, d.type, case d.type when 'invoice' then d.doc_id % 11 <> 0 and d.doc_id % 3 <> 0 when 'receipt' then d.doc_id % 3 <> 0 else true end as is_complete from invoice_docs d""")
def mandatory_fields(t):
    return V.mandatory_check(t.invoice_docs, t.sparse_fields)


@query("P15", views="invoice_docs", sql="""
select doc_id, type, case type when 'tax_invoice' then 'tax_id,total_amount' when 'receipt' then 'receipt_number,date,vendor,total_amount,payment_method'
  else 'invoice_number,invoice_date,vendor_name,total_amount,tax_id,subtotal,vat' end as fields from invoice_docs""")
def fields_per_type(t):
    definitions = t.invoice_docs.select(F.col("type").alias("name")).distinct().select(
        "name", F.lit('["tax_id","total_amount"]').alias("fields_schema"), (F.col("name") == "tax_invoice").alias("active"))
    out = V.fields_to_extract(t.invoice_docs, definitions)
    return out.select("doc_id", "type", F.array_join("fields", ",").alias("fields"))


RULES = {
    "*": [V.FieldRule("total_amount", "required"), V.FieldRule("vendor_name", "max_length", 12), V.FieldRule("subtotal", "max", 200000)],
    "invoice": [V.FieldRule("vat", "min", 1000, "vat too small"), V.FieldRule("invoice_number", "pattern", "^INV-[0-9]+$")],
}


@query("X33 A24", views="invoice_docs", sql="""
select doc_id, 'vendor_name' as field_name, 'max_length' as rule, 'vendor_name fails max_length' as message from invoice_docs where length(vendor_name) > 12
union all select doc_id, 'subtotal', 'max', 'subtotal fails max' from invoice_docs where subtotal > 200000
union all select doc_id, 'vat', 'min', 'vat too small' from invoice_docs where type = 'invoice' and vat < 1000""")
def rule_issues(t):
    wide = V.wide_fields(t.extracted_fields, ["invoice_number", "subtotal", "vat", "total_amount", "vendor_name"])
    return V.rule_issues(wide.join(t.invoice_docs.select("doc_id", "type"), "doc_id"), RULES)


@query("A24", views="extracted_fields", sql="""
select doc_id, max_by(case when field_name = 'invoice_number' then field_value end, case when field_name = 'invoice_number' then field_id end) as invoice_number,
  max(case when field_name = 'vendor_name' then field_value end) as vendor_name, max(case when field_name = 'total_amount' then field_value end) as total_amount
from extracted_fields group by doc_id""")
def wide_documents(t):
    return V.wide_fields(t.extracted_fields, ["invoice_number", "vendor_name", "total_amount"])


@query("P12", views="extracted_fields", sql="""
select doc_id, count(*) as scores, count(*) filter (where c > 1 or c < 0) as invalid_scores, count(*) filter (where c > 1 or c < 0) = 0 as is_valid
from (select doc_id, confidence * 2 - 0.5 as c from extracted_fields) group by doc_id""")
def confidence_score_check(t):
    f = t.extracted_fields.withColumn("confidence", F.col("confidence") * 2 - F.expr("0.5"))
    return V.confidence_score_issues(f)


@query("P9", views="extracted_fields", sql="select field_id, field_name, cast(confidence as double) as confidence from extracted_fields where confidence >= 0.7")
def high_confidence_fields(t):
    return R.high_confidence_fields(t.extracted_fields).select("field_id", "field_name", "confidence")


@query("P10", views="extracted_fields", sql="select doc_id, field_id, field_name, field_value, cast(confidence as double) as confidence, page_number from extracted_fields where confidence < 0.8")
def low_confidence_fields(t):
    return R.low_confidence_fields(t.extracted_fields)


@query("P11", views="extracted_fields item_fields", sql="""
select case when starts_with(field_name, 'item_') then 'line_item' else 'header' end as part, count(*) as fields
from (select field_name from extracted_fields union all select field_name from item_fields) group by 1""")
def header_item_split(t):
    f = t.extracted_fields.select("field_name").unionByName(t.item_fields.select("field_name"))
    return f.groupBy(F.when(F.startswith("field_name", F.lit("item_")), "line_item").otherwise("header").alias("part")).agg(F.count("*").alias("fields"))


@query("A18", views="extracted_fields", sql="""
select doc_id, count(*) as total_fields, count(*) filter (where is_edited) as manual, count(*) filter (where not is_edited) as ocr,
  cast(sum(confidence) as double) / count(*) as avg_confidence, bool_or(is_edited) as has_manual_edits from extracted_fields group by doc_id""")
def extraction_sources(t):
    return R.extraction_sources(t.extracted_fields)


@query("A19", views="extracted_fields", sql="""
select doc_id, coalesce(page_number, 0) as page_number, count(*) as total_fields, count(confidence) as with_confidence, cast(sum(confidence) as double) / count(*) as avg_confidence,
  count(*) filter (where confidence >= 0.9) as high, count(*) filter (where confidence >= 0.7 and confidence < 0.9) as medium, count(*) filter (where confidence < 0.7) as low
from extracted_fields group by grouping sets ((doc_id, page_number), (doc_id))""")
def confidence_report(t):
    return R.page_confidence(t.extracted_fields).withColumn("page_number", F.coalesce("page_number", F.lit(0)))


@query("A20", views="extracted_fields", sql="""
select doc_id, mean_conf as document_confidence, greatest(0, least(1, mean_conf * ok * 0.9::double)) as table_score from (
  select doc_id, cast(sum(confidence) as double) / count(*) as mean_conf, count(*) filter (where confidence >= 0.5) / count(*) as ok from extracted_fields group by doc_id)""")
def document_confidence(t):
    g = t.extracted_fields.groupBy("doc_id").agg(CF.mean("confidence").alias("m"), CF.share(F.col("confidence") >= 0.5).alias("ok"))
    return g.select("doc_id", F.col("m").alias("document_confidence"), CF.table_score(F.col("m"), F.col("ok"), F.lit(0.9)).alias("table_score"))


@query("X34", views="extracted_fields", sql="""
select field_id, cast(case when is_corrected then greatest(0, confidence - 0.15) else confidence end as double) as value,
  case when is_corrected then concat(cast(confidence as varchar), ',', cast(cast(greatest(0, confidence - 0.15) as decimal(5,4)) as varchar)) else cast(confidence as varchar) end as history
from extracted_fields""")
def validation_penalty(t):
    ok = ~F.col("is_corrected")
    c = F.col("confidence")
    return t.extracted_fields.select(
        "field_id", CF.adjust_for_validation(c, ok).alias("value"),
        F.array_join(CF.adjusted_history(F.array(c), c, ok).cast("array<string>"), ",").alias("history"))


# Routing

RULE = {"default": (0.85, 0.6, "review_required"), "strict": (0.9, 0.7, "rejected"), "lenient": (0.75, 0.5, "review_required")}


def status_sql(c: str, rule: str) -> str:
    high, medium, low = RULE[rule]
    return f"case when {c} > {high} then 'approved' when {c} >= {medium} then 'review_required' else '{low}' end"


def level_sql(c: str, rule: str) -> str:
    high, medium, _ = RULE[rule]
    return f"case when {c} > {high} then 'high' when {c} >= {medium} then 'medium' else 'low' end"


@query("X36 X37", views="extracted_fields", sql=" union all ".join(
    f"select '{r}' as rule, {level_sql('confidence', r)} as level, {status_sql('confidence', r)} as routing_status, count(*) as fields from extracted_fields group by all" for r in RULE))
def field_routing(t):
    out = None
    for r in RULE:
        g = R.route_fields(t.extracted_fields, r).groupBy("level", "routing_status").agg(F.count("*").alias("fields")).withColumn("rule", F.lit(r))
        out = g if out is None else out.unionByName(g)
    return out


def component_sql(rows: str, keys: str, rule: str, denominator: str) -> str:
    high, medium, _ = RULE[rule]
    return f"""select {keys}, count(*) as fields, coalesce(cast(sum(coalesce(confidence, 0)) as double) / nullif({denominator}, 0), 0.0) as avg_confidence,
  cast(min(coalesce(confidence, 0)) as double) as min_confidence, cast(max(coalesce(confidence, 0)) as double) as max_confidence,
  count(*) filter (where {status_sql('coalesce(confidence, 0)', rule)} <> 'approved') = 0 as all_approved,
  count(*) filter (where coalesce(confidence, 0) < 0.3) as very_low_fields,
  count(*) filter (where coalesce(confidence, 0) >= 0.3 and {status_sql('coalesce(confidence, 0)', rule)} = 'review_required') as review_fields,
  max(coalesce(confidence, 0)) - min(coalesce(confidence, 0)) > 0.4 as high_variance from {rows} group by {keys}"""


@query("X38 X40", views="extracted_fields", sql=f"""
select *, {level_sql('avg_confidence', 'default')} as level, {status_sql('avg_confidence', 'default')} as routing_status, avg_confidence < 0.6 as low_average
from ({component_sql('extracted_fields', 'doc_id', 'default', 'count(confidence)')})""")
def header_routing(t):
    return R.route_header(t.extracted_fields)


ITEMS = "(select doc_id, cast(regexp_extract(field_name, '_([0-9]+)_', 1) as int) as row_idx, field_name, confidence from item_fields)"


def item_cells(t):
    return t.item_fields.withColumn("row_idx", F.regexp_extract("field_name", "_([0-9]+)_", 1).cast("int"))


@query("X39 X40", views="item_fields", sql=f"""
select *, {level_sql('avg_confidence', 'strict')} as level, {status_sql('avg_confidence', 'strict')} as routing_status, avg_confidence < 0.7 as low_average
from ({component_sql(ITEMS, 'doc_id, row_idx', 'strict', 'count(*)')})""")
def row_routing(t):
    return R.route_rows(item_cells(t), "strict")


@query("X40", views="extracted_fields", sql=f"""
with h as (select *, avg_confidence < 0.6 as low_average from ({component_sql('extracted_fields', 'doc_id', 'default', 'count(confidence)')}))
select doc_id, concat(case when confidence < 0.3 then 'VERY_LOW_CONFIDENCE: ' else 'REVIEW_NEEDED: ' end, field_name, ' (', cast(cast(confidence as decimal(5,2)) as varchar), ')') as flag
from extracted_fields where confidence <= 0.85
union all select doc_id, concat('HIGH_CONFIDENCE_VARIANCE: header (range: ', cast(cast(min_confidence as decimal(5,2)) as varchar), '-', cast(cast(max_confidence as decimal(5,2)) as varchar), ')') from h where high_variance
union all select doc_id, concat('LOW_AVERAGE_CONFIDENCE: header (', cast(cast(avg_confidence as decimal(5,2)) as varchar), ')') from h where low_average""")
def routing_flags(t):
    return R.component_flags(t.extracted_fields, R.route_header(t.extracted_fields))


def routed_sql(rule: str) -> str:
    high, medium, low = RULE[rule]
    strict = "true" if rule == "strict" else "false"
    return f"""h as (select doc_id, {status_sql('avg_confidence', rule)} as header_status from ({component_sql('extracted_fields', 'doc_id', rule, 'count(confidence)')})),
rw as (select doc_id, count(*) filter (where s = 'review_required') as review_rows, count(*) filter (where s = 'rejected') as rejected_rows from (
  select doc_id, {status_sql('avg_confidence', rule)} as s from ({component_sql(ITEMS, 'doc_id, row_idx', rule, 'count(*)')})) group by doc_id),
lw as (select doc_id, count(*) filter (where confidence < {medium}) as low_fields, cast(sum(confidence) as double) as cs, count(*) as cn,
  (select string_agg(field_name, ', ' order by field_id) from (select field_name, field_id from extracted_fields x where x.doc_id = f.doc_id and x.confidence < {medium})) as focus_fields
  from extracted_fields f group by doc_id),
b as (select d.doc_id, d.confidence as c, h.header_status, coalesce(review_rows, 0) as review_rows, coalesce(rejected_rows, 0) as rejected_rows, low_fields, cs, cn, focus_fields
  from invoice_docs d join h using (doc_id) join lw using (doc_id) left join rw using (doc_id)),
routed as (select *, case when header_status = 'rejected' or rejected_rows > 0 then 'rejected'
    when {strict} and not (header_status = 'approved' and review_rows = 0 and rejected_rows = 0) then 'review_required' else {status_sql('c', rule)} end as routing_status,
  case when header_status = 'rejected' or rejected_rows > 0 then 'A part of the document was rejected'
    when {strict} and not (header_status = 'approved' and review_rows = 0 and rejected_rows = 0) then 'Some parts still wait for approval'
    else concat('Confidence level of the whole document: ', {level_sql('c', rule)}) end as routing_reason from b)"""


@query("X41 L6", views="extracted_fields item_fields", sql=f"""with {routed_sql('default')}
select doc_id, routing_status, routing_reason, header_status, low_fields, review_rows + rejected_rows as attention_rows,
  (cast(c as double) + cs) / (1 + cn) as avg_component_confidence, routing_status <> 'approved' or low_fields > 0 as requires_attention, focus_fields from routed""")
def document_routing(t):
    return R.route_documents(t.invoice_docs, t.extracted_fields, item_cells(t)).drop("review_rows")


@query("X41 L6", views="extracted_fields item_fields", sql=f"""with {routed_sql('strict')}
select action, count(*) as documents from (
  select unnest(list_filter([
    case when routing_status = 'approved' then 'Approved: pass the document on' end,
    case when routing_status = 'review_required' then 'Hand the document to a reviewer' end,
    case when routing_status = 'review_required' and header_status = 'review_required' then 'Look at uncertain header fields' end,
    case when routing_status = 'review_required' and review_rows > 0 then 'Look at uncertain table rows' end,
    case when routing_status = 'review_required' and low_fields > 0 then concat('Start with these fields: ', focus_fields) end,
    case when routing_status = 'rejected' then 'Rejected: read the document again or key it in' end,
    case when routing_status = 'rejected' then 'Confidence is below the lowest threshold: extract again or correct by hand' end,
    'Correct the errors that were found'], lambda x: x is not null)) as action from routed) group by action""")
def recommended_actions(t):
    routed = R.route_documents(t.invoice_docs, t.extracted_fields, item_cells(t), "strict")
    return R.recommended_actions(routed, "strict").groupBy("action").agg(F.count("*").alias("documents"))


@query("A14", views="extracted_fields item_fields", sql=f"""with {routed_sql('lenient')}
select count(*) as total, count(*) filter (where routing_status = 'approved') as approved, count(*) filter (where routing_status = 'review_required') as review_required,
  count(*) filter (where routing_status = 'rejected') as rejected, count(*) filter (where routing_status = 'approved') / count(*) as approval_rate,
  count(*) filter (where routing_status = 'review_required') / count(*) as review_rate, count(*) filter (where routing_status = 'rejected') / count(*) as rejection_rate from routed""")
def routing_statistics(t):
    return R.routing_statistics(R.route_documents(t.invoice_docs, t.extracted_fields, item_cells(t), "lenient"))


@query("A14", views="extracted_fields", sql="""
select doc_id, field_name, cast(confidence * 1.25 - 0.1 as double) as confidence from extracted_fields where confidence * 1.25 - 0.1 not between 0 and 1""")
def out_of_range_scores(t):
    """Scores outside 0..1, from a scorer that is off scale."""
    off = (F.col("confidence") * F.expr("1.25") - F.expr("0.1")).cast("decimal(12,6)")
    return V.bad_scores(t.extracted_fields.withColumn("confidence", off))
