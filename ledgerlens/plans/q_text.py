"""Classification, header extraction and text expressions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerlens.functions import classify as K
from ledgerlens.functions import text as X
from ledgerlens.functions.confidence import text_quality
from ledgerlens.functions.header import ANCHORS, LABEL_PATTERNS
from ledgerlens.operators import extraction as E
from ledgerlens.operators.validation import FieldRule
from ledgerlens.plans import document_job
from ledgerlens.plans import staged_job as SG
from ledgerlens.plans.registry import query
from ledgerlens.schemas import HEADER_FIELDS

# Check SQL for the keyword classifier. The check engine has no lookarounds, so an edge is a
# non-word character or the end of the text.

EDGE = r"[^\pL\pN_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def edge_regex(word: str) -> str:
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", word)
    left = f"(^|{EDGE})" if word[0].isalnum() else ""
    right = f"({EDGE}|$)" if word[-1].isalnum() else ""
    return left + quoted + right


WORDS = list(dict.fromkeys(w for k in K.KEYWORD_SETS.values() for w in [*k.positive(), *k.negative]))


def classify_sql(source: str) -> str:
    """``source``: a query giving (id, text)."""
    flags = ", ".join(
        f"case when contains(t, {lit(w)}) and regexp_matches(t, {lit(edge_regex(w))}) then 1 else 0 end as k{i}" for i, w in enumerate(WORDS))

    def weighted(k):
        terms = [f"{wt} * k{WORDS.index(w)}" for ws, wt in ((k.primary, 10), (k.secondary, 6), (k.tertiary, 3), (k.negative, -20)) for w in ws]
        return f"greatest(0, {' + '.join(terms)}) / 10.0::double"

    def named(k):
        return "list_filter([" + ", ".join(f"case when k{WORDS.index(w)} = 1 then {lit(w)} end" for w in k.positive()) + "], lambda x: x is not null)"

    scores = ", ".join(f"{weighted(k)} as score_{n}" for n, k in K.KEYWORD_SETS.items())
    lists = ", ".join(f"{named(k)} as words_{n}" for n, k in K.KEYWORD_SETS.items())
    top = "greatest(" + ", ".join(f"score_{n}" for n in K.KEYWORD_SETS) + ")"
    first = "case " + " ".join(f"when score_{n} = top and top >= {k.threshold} then '{n}' when score_{n} = top then 'unknown'" for n, k in K.KEYWORD_SETS.items()) + " end"
    words = "case doc_type " + " ".join(f"when '{n}' then words_{n}" for n in K.KEYWORD_SETS) + " else [] end"
    return f"""src as ({source}),
norm as (select id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as t from src),
flags as (select id, {flags} from norm),
scored as (select id, {scores}, {lists} from flags),
topped as (select *, {top} as top from scored),
typed as (select *, {first} as doc_type from topped),
won as (select *, case when doc_type = 'unknown' then 0.0 else least(1.0, top) end::double as type_confidence, {words} as matched from typed)"""


DOCS = "select doc_id as id, text from documents"
LINES = "select doc_id as id, string_agg(text, ' ' order by line_no) as text from doc_lines group by doc_id"


@query("X1 X2 X6", sql="with " + classify_sql(DOCS) + " select id as doc_id, doc_type, type_confidence, len(matched) as keywords from won")
def classify_corpus(t):
    return K.keyword_classify(t.documents, "text").select(
        "doc_id", "doc_type", "type_confidence", F.size("matched_keywords").cast("long").alias("keywords"))


@query("X1 X2", views="doc_lines", sql="with " + classify_sql(LINES) + """
select id as doc_id, doc_type, type_confidence, array_to_string(list_sort(matched), ',') as matched,
  score_invoice, score_receipt, score_purchase_order, score_tax_invoice from won""")
def classify_business_documents(t):
    d = E.document_text(t.doc_lines).withColumn("joined", F.array_join("lines", " "))
    out = K.keyword_classify(d, "joined")
    return out.select("doc_id", "doc_type", "type_confidence", F.array_join(F.sort_array("matched_keywords"), ",").alias("matched"),
                      *[f"score_{n}" for n in K.KEYWORD_SETS])


@query("A28", views="doc_lines", sql="with " + classify_sql(LINES) + """
select doc_type, count(*) as documents, cast(sum(cast(type_confidence * 10 as bigint)) as bigint) as confidence_tenths,
  count(*) filter (where type_confidence >= 0.8) as high_confidence from won group by doc_type""")
def classification_summary(t):
    d = E.document_text(t.doc_lines).withColumn("joined", F.array_join("lines", " "))
    return E.classification_summary(K.keyword_classify(d, "joined"))


LENGTH = r"""heur as (select id, length(text) > 1000 as long_text,
  len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) > 3)) > 100 as wordy from (select doc_id as id, text from documents)),
len_best as (select id, case when long_text then 'invoice' when wordy then 'receipt' else 'invoice' end as type,
  case when long_text or wordy then 0.6 else 0.5 end::double as confidence from heur)"""


@query("X4", sql="with " + LENGTH + " select id as doc_id, type, confidence from len_best")
def length_heuristic(t):
    return t.documents.select("doc_id", K.length_classify("text").alias("r")).select("doc_id", "r.*")


@query("X3", sql="with " + classify_sql(DOCS) + ", " + LENGTH + """
select w.id as doc_id, case when w.type_confidence < 0.4 then l.type else w.doc_type end as doc_type,
  case when w.type_confidence < 0.4 then l.confidence else w.type_confidence end as type_confidence,
  case when w.type_confidence >= 0.8 then 'keyword_high_confidence' when w.type_confidence < 0.4 then 'second_model' else 'keyword_medium_confidence' end as method,
  case when w.type_confidence < 0.4 then w.type_confidence else -1 end::double as keyword_backup_score
from won w join len_best l on l.id = w.id""")
def hybrid_classification(t):
    d = K.hybrid_classify(t.documents.select("doc_id", "text"), "text", K.length_classify("text"))
    return d.select("doc_id", "doc_type", "type_confidence", "method", F.coalesce("keyword_backup_score", F.lit(-1.0)).alias("keyword_backup_score"))


PATTERN_ROWS = ", ".join(f"({i}, {lit(n)}, {lit(w)})" for i, (n, ws) in enumerate(
    {**K.PATTERNS, "letter": ["letter", "the"]}.items()) for w in ws)


def pattern_sql(source: str, rows: str = PATTERN_ROWS) -> str:
    return f"""psrc as ({source}),
pk as (select * from (values {rows}) k(turn, type, word)),
ps as (select id, k.turn, k.type, count(*) filter (where contains(lower(text), word)) as score from psrc cross join pk k group by all),
pr as (select *, row_number() over (partition by id order by score desc, turn) as rn from ps),
pattern as (select a.id, case when a.score > 0 and a.score > 1.5 * b.score then a.type else 'invoice' end as type
  from pr a join pr b on b.id = a.id and b.rn = 2 where a.rn = 1)"""


@query("X5", sql="with " + pattern_sql(DOCS) + " select id as doc_id, type from pattern")
def pattern_classification(t):
    return t.documents.select("doc_id", K.pattern_classify("text", {"letter": ["Letter", "the"]}).alias("type"))


@query("X6 X7", sql=r"""
select lang, count(*) filter (where regexp_matches(text, '[\x{0E00}-\x{0E7F}]')) as thai,
  cast(sum(length(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))) as bigint) as chars from documents group by lang""")
def text_profile(t):
    return t.documents.groupBy("lang").agg(
        F.count_if(X.has_thai("text")).alias("thai"), F.sum(F.length(X.normalize_text("text"))).alias("chars"))


@query("X8", sql=r"""
select event_id, concat(cast(event_id as varchar), '_', replace(replace(n, '/', '_'), '\', '_'), case when ends_with(lower(n), ext) then '' else ext end) as export_name
from (select event_id, case event_id % 3 when 0 then concat(event_type, '/', cast(user_id as varchar), '.PDF') when 1 then concat(event_type, '\', 'x') else concat(' ', event_type, '.png') end as raw,
  trim(case event_id % 3 when 0 then concat(event_type, '/', cast(user_id as varchar), '.PDF') when 1 then concat(event_type, '\', 'x') else concat(' ', event_type, '.png') end) as n,
  '.pdf' as ext from events)""")
def export_names(t):
    e = F.col("event_id")
    name = F.when(e % 3 == 0, F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(".PDF"))).when(
        e % 3 == 1, F.concat("event_type", F.lit("\\"), F.lit("x"))).otherwise(F.concat(F.lit(" "), "event_type", F.lit(".png")))
    path = F.concat(F.lit("store/2024/"), e.cast("string"), F.lit(".pdf"))
    return t.events.select("event_id", X.safe_export_name("event_id", name, path).alias("export_name"))


@query("X43", sql=r"""
select event_id, upper(event_type) as up, lower(upper(event_type)) as low, trim(concat(' ', event_type, ' ')) as cut,
  concat(upper(substr(event_type, 1, 1)), substr(event_type, 2), '''', upper(substr(event_type, 1, 1)), substr(event_type, 2), ' 7', upper(substr(event_type, 1, 1)), substr(event_type, 2)) as title,
  concat(upper(substr(event_type, 1, 1)), substr(event_type, 2)) as capital, event_type as same from events""")
def value_transforms(t):
    c = F.col("event_type")
    return t.events.select(
        "event_id", X.apply_transform(c, "uppercase").alias("up"), X.apply_transform(F.upper(c), "lowercase").alias("low"),
        X.apply_transform(F.concat(F.lit(" "), c, F.lit(" ")), "trim").alias("cut"),
        X.apply_transform(F.concat(c, F.lit("'"), c, F.lit(" 7"), c), "title").alias("title"),
        X.apply_transform(F.upper(c), "capitalize").alias("capital"), X.apply_transform(c, "nonesuch").alias("same"))


@query("X44", views="extracted_fields", sql="""
select field_name, count(try_cast(field_value as decimal(28,6))) as numbers, count(*) - count(try_cast(field_value as decimal(28,6))) as kept_as_text,
  cast(sum(try_cast(field_value as decimal(28,6))) as double) as total, count(*) filter (where lower(field_value) in ('true', 'yes', '1')) as true_values
from extracted_fields group by field_name""")
def value_casts(t):
    v = F.col("field_value")
    return t.extracted_fields.groupBy("field_name").agg(
        F.count(X.cast_value(v, "number")).alias("numbers"), F.count_if(~X.cast_ok(v, "number")).alias("kept_as_text"),
        F.sum(X.cast_value(v, "decimal")).cast("double").alias("total"), F.count_if(X.cast_value(v, "boolean")).alias("true_values"))


@query("X48", sql="""
select event_id, case event_id % 4 when 0 then cast(user_id as varchar) when 1 then event_type when 2 then props else 'fallback' end as value from events""")
def config_values(t):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.col("user_id").cast("string")).when(e % 4 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(
        e % 4 == 2, F.col("props"))
    value = X.config_value(raw, "fallback")
    compact = F.when(e % 4 == 2, F.regexp_replace(value, ":", ": ")).otherwise(value)
    return t.events.select("event_id", compact.alias("value"))


# Header extraction

LABEL_SQL = {f: r"(?im)(?:^|[^\pL\pN])" + p for f, p in LABEL_PATTERNS.items()}
AMOUNTS = ("subtotal", "vat", "total_amount")


def label_cte() -> str:
    parts = []
    for f in HEADER_FIELDS:
        raw = f"trim(regexp_extract(text, {lit(LABEL_SQL[f])}, 1))"
        value = raw
        if f in AMOUNTS:
            value = f"regexp_replace(cast(cast(replace({raw}, ',', '') as decimal(20,4)) as varchar), '(\\.\\d+?)0+$', '\\1')"
        elif f == "invoice_number":
            value = f"upper({raw})"
        parts.append(f"select id as doc_id, '{f}' as field_name, {value} as value from dt where {raw} <> ''")
    return ("dt as (select doc_id as id, string_agg(text, chr(10) order by line_no) as text from doc_lines group by doc_id),\n"
            "lab as (" + "\nunion all ".join(parts) + "),\n"
            "label as (select *, case when length(trim(value)) < 2 then 0.475 else 0.95 end::double as confidence from lab)")


def anchor_cte() -> str:
    out = ["ln as (select doc_id, line_no, text, lead(text, 1) over w as n1, lead(text, 2) over w as n2, lead(text, 3) over w as n3 "
           "from doc_lines window w as (partition by doc_id order by line_no))"]
    parts = []
    for f, (words, shape) in ANCHORS.items():
        rows = ", ".join(f"({i}, {lit(w)})" for i, w in enumerate(words))
        cut = "substr(text, cast(instr(lower(text), anchor) + length(anchor) as integer))"
        values = ", ".join(
            f"nullif(trim(regexp_extract({src}, {lit(shape)}, 1), ' ' || chr(9) || chr(10)), '') as v{k}" for k, src in enumerate((cut, "n1", "n2", "n3")))
        parts.append(f"select doc_id, '{f}' as field_name, line_no, turn, {values} from ln join (values {rows}) a(turn, anchor) on contains(lower(text), anchor)")
    out.append("av as (" + "\nunion all ".join(parts) + ")")
    # base * proximity per distance, and its half for one-character values
    out.append("""ac as (select *, coalesce(v0, v1, v2, v3) as value,
  case when v0 is not null then 0.8 when v1 is not null then 0.51 when v2 is not null then 0.35 else 0.22 end as s from av),
anchor_all as (select *, (case when length(value) < 2 then s / 2 else s end)::double as confidence from ac where value is not null),
anchor as (select doc_id, field_name, value, confidence from (select *, row_number() over (partition by doc_id, field_name order by confidence desc, line_no, turn) as rn from anchor_all) where rn = 1)""")
    return ",\n".join(out)


@query("X10 X11 X14", views="doc_lines", sql="with " + label_cte() + " select doc_id, field_name, value, confidence from label")
def header_by_label(t):
    return E.label_results(E.document_text(t.doc_lines))


@query("X12 X13 W3", views="doc_lines", sql="with " + anchor_cte() + " select doc_id, field_name, value, confidence from anchor")
def header_by_anchor(t):
    return E.anchor_results(E.document_text(t.doc_lines))


RESULTS = "with " + label_cte() + ",\n" + anchor_cte() + """,
results as (select doc_id, field_name, 1 as stage_no, value, confidence from label
  union all select a.doc_id, a.field_name, 2, a.value, a.confidence from anchor a
    where not exists (select 1 from label l where l.doc_id = a.doc_id and l.field_name = a.field_name and l.confidence > 0.5)),
chosen as (select * from (select *, row_number() over (partition by doc_id, field_name order by stage_no) as rn from results
  where (stage_no = 1 and confidence > 0.5) or (stage_no = 2 and confidence > 0.4)) where rn = 1)"""


@query("W4 U6 X15", views="doc_lines", sql=RESULTS + " select doc_id, field_name, stage_no, value, confidence from chosen")
def header_stage_choice(t):
    chosen = E.choose_stage(E.header_results(E.document_text(t.doc_lines)))
    return chosen.select("doc_id", "field_name", "stage_no", "value", "confidence")


@query("X15 W4 C2", views="doc_lines", sql=RESULTS + " select doc_id, field_name, stage_no, value, confidence from chosen")
def header_extraction(t):
    return E.chosen_headers(E.document_text(t.doc_lines))


@query("W5", views="doc_lines", sql=RESULTS + """
select stage_no, count(*) as documents from (select doc_id, max(stage_no) as stage_no from results group by doc_id) group by stage_no""")
def final_stage_distribution(t):
    return E.stage_distribution(E.header_results(E.document_text(t.doc_lines)))


@query("W3", views="doc_lines", sql="with " + anchor_cte() + """
select doc_id, field_name, value, confidence, cast(line_no as integer) as line_no, turn as anchor_no from (
  select *, row_number() over (partition by doc_id, field_name order by confidence desc, line_no, turn) as rn from anchor_all) where rn = 1""")
def best_candidates(t):
    """All candidates of all anchors as a long table; the best per (document, field)."""
    return E.best_candidates(E.anchor_candidates(E.document_text(t.doc_lines), list(ANCHORS)))


@query("X12 X13", views="doc_lines", sql="with " + anchor_cte() + """
select doc_id, field_name, value, confidence, cast(line_no as integer) as line_no, turn as anchor_no from anchor_all""")
def anchor_candidates(t):
    return E.anchor_candidates(E.document_text(t.doc_lines), list(ANCHORS))


@query("A15", views="doc_lines", sql=RESULTS + """
select f.field_name, count(c.doc_id) as found, coalesce(cast(sum(cast(c.confidence as decimal(5,4))) as double) / count(c.doc_id), 0.0) as avg_confidence,
  count(*) filter (where confidence < 0.25) as bin_0, count(*) filter (where confidence >= 0.25 and confidence < 0.5) as bin_1,
  count(*) filter (where confidence >= 0.5 and confidence < 0.75) as bin_2, count(*) filter (where confidence >= 0.75) as bin_3,
  (select count(*) from dt) as documents, count(c.doc_id) / (select count(*) from dt) as success_rate
from (values """ + ", ".join(f"('{f}')" for f in HEADER_FIELDS) + """) f(field_name) left join chosen c on c.field_name = f.field_name group by f.field_name""")
def header_statistics(t):
    docs = E.document_text(t.doc_lines)
    return E.field_statistics(E.chosen_headers(docs), docs)


@query("X13", views="extracted_fields", sql=r"""
select field_id, case when field_value = '' then 0.1
  when field_name in ('subtotal', 'vat', 'total_amount', 'invoice_number') then case when regexp_matches(field_value, '\d') then 0.9 else 0.3 end
  when field_name = 'vendor_name' then case when length(field_value) >= 3 then 0.85 else 0.4 end else 0.7 end::double as quality from extracted_fields""")
def text_quality_scores(t):
    return t.extracted_fields.select("field_id", text_quality(F.col("field_value"), F.col("field_name")).alias("quality"))


CHECKS = r"""f as (select c.*, case when field_name in ('subtotal', 'vat', 'total_amount') then 'currency' when field_name = 'invoice_date' then 'date' else 'text' end as kind,
  regexp_extract(value, '(\d{1,2})/(\d{1,2})/(\d{4})', ['d', 'm', 'y']) as p from chosen c),
d as (select *, case when kind = 'date' then try_cast(concat_ws('-', case when try_cast(p.y as int) >= 2400 then try_cast(p.y as int) - 543 else try_cast(p.y as int) end, p.m, p.d) as date) end as day,
  case when kind = 'currency' then try_cast(value as decimal(20,4)) end as amount from f),
k as (select *, case kind when 'date' then day is not null and day <= date '2024-06-30' when 'currency' then amount is not null else true end as ok,
  case kind when 'date' then case when day is null then 0.4 when day > date '2024-06-30' then 0.2 else 0.05 end
    when 'currency' then case when amount is null then 0.3 when amount = 0 then 0.3 else 0.05 end else 0.0 end as adj from d),
g as (select doc_id, count(*) as fields, count(*) filter (where not ok) as bad, sum(adj)::double / count(*) as confidence_adjustment,
  cast(sum(cast(confidence as decimal(5,4))) as double) / count(*) as mean_confidence,
  max(case when field_name = 'subtotal' then amount end) as s, max(case when field_name = 'vat' then amount end) as v, max(case when field_name = 'total_amount' then amount end) as t
  from k group by doc_id)"""

BATCH = RESULTS + ", " + pattern_sql("select id, text from dt", ", ".join(
    f"({i}, {lit(n)}, {lit(w)})" for i, (n, ws) in enumerate(K.PATTERNS.items()) for w in ws)) + ",\n" + CHECKS + """
select doc_id, p.type, fields, bad + case when abs(s + v - t) > 0.05 then 1 else 0 end as invalid_count, confidence_adjustment, mean_confidence,
  bad = 0 and not coalesce(abs(s + v - t) > 0.05, false) as overall_valid,
  case when mean_confidence < 0.8 or bad > 0 or coalesce(abs(s + v - t) > 0.05, false) then 'needs_review' else 'completed' end as status,
  case when mean_confidence < 0.8 and (bad > 0 or coalesce(abs(s + v - t) > 0.05, false)) then concat('Low confidence (', printf('%.2f', mean_confidence), ' < 0.8) | Validation failed')
    when mean_confidence < 0.8 then concat('Low confidence (', printf('%.2f', mean_confidence), ' < 0.8)')
    when bad > 0 or coalesce(abs(s + v - t) > 0.05, false) then 'Validation failed' end as review_reason
from g join pattern p on p.id = g.doc_id"""


@query("C1 X42 X29", views="doc_lines", sql=BATCH)
def document_batch(t):
    return document_job.process(t.doc_lines, "2024-06-30").select(
        "doc_id", "type", "fields", "invalid_count", "confidence_adjustment", "mean_confidence", "overall_valid", "status", "review_reason")


@query("C2", sql="""with doc_lines as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
  from documents), """ + RESULTS.removeprefix("with ") + ", " + pattern_sql(DOCS, ", ".join(
    f"({i}, {lit(n)}, {lit(w)})" for i, (n, ws) in enumerate(K.PATTERNS.items()) for w in ws)) + """
select c.doc_id, p.type, c.field_name, c.stage_no, c.value, c.confidence from chosen c join pattern p on p.id = c.doc_id""")
def extract_from_corpus(t):
    """Ad-hoc extraction over the corpus: type and all fields with their stage and confidence."""
    return document_job.extract_text(t.documents).select("doc_id", "type", "field_name", "stage_no", "value", "confidence")


# The job in stages


def length_model(batch):
    """Stands for a user's model: the length of the text for every wanted field, as sure as can be said."""
    long = batch.explode("fields")
    return long.assign(field_name=long["fields"], value=long["text"].str.len().astype(str), confidence=0.85)[["doc_id", "field_name", "value", "confidence"]]


JOB_RULES = {"*": [FieldRule("total_amount", "required"), FieldRule("vendor_name", "max_length", 12)], "receipt": [FieldRule("payment_method", "min", 100)]}

STAGED = "with " + label_cte() + ",\n" + anchor_cte() + """,
pattern as (select doc_id as id, type from invoice_docs),
want as (select id as doc_id, type, unnest(case type when 'tax_invoice' then ['tax_id', 'total_amount'] when 'receipt' then ['receipt_number', 'date', 'vendor', 'total_amount', 'payment_method']
  else ['invoice_number', 'invoice_date', 'vendor_name', 'total_amount', 'tax_id', 'subtotal', 'vat'] end) as field_name from pattern),
b1 as (select w.doc_id, w.field_name, l.value, l.confidence, 1 as stage_no from want w join label l using (doc_id, field_name) where l.confidence > 0.5),
n1 as (select w.doc_id, count(*) as n, count(b.doc_id) as found, count(*) filter (where b.confidence > 0.8) as sure from want w left join b1 b using (doc_id, field_name) group by 1),
o2 as (select doc_id from n1 where 10 * sure < 7 * n),
b2 as (select * from (select *, row_number() over (partition by doc_id, field_name order by confidence desc, stage_no) as rn from (select * from b1 union all
  select w.doc_id, w.field_name, a.value, a.confidence, 2 from want w join anchor a using (doc_id, field_name) where a.confidence > 0.4 and w.doc_id in (select doc_id from o2))) where rn = 1),
n2 as (select w.doc_id, count(*) as n, count(b.doc_id) as found from want w left join b2 b using (doc_id, field_name) where w.doc_id in (select doc_id from o2) group by 1),
o3 as (select doc_id from n2 where found < n),
chosen as (select doc_id, field_name, value, confidence, stage_no from (select *, row_number() over (partition by doc_id, field_name order by confidence desc, stage_no) as rn from (
  select doc_id, field_name, value, confidence, stage_no from b2 union all
  select w.doc_id, w.field_name, length(dt.text)::varchar, 0.85::double, 3 from want w join dt on dt.id = w.doc_id where w.doc_id in (select doc_id from o3))) where rn = 1),
lasts as (select id as doc_id, type, case when id in (select doc_id from o3) then 3 when id in (select doc_id from o2) then 2 else 1 end as last_stage from pattern)"""


def staged(t):
    definitions = t.spark.createDataFrame([("tax_invoice", '["tax_id","total_amount"]', True), ("invoice", '["total_amount"]', False)], "name string, fields_schema string, active boolean")
    docs = SG.prepared(E.document_text(t.doc_lines).join(t.invoice_docs.select("doc_id", "type"), "doc_id"), definitions)
    return SG.extract(docs, [SG.label_stage(), SG.anchor_stage(), SG.model_stage(length_model)])


@query("C1 X15 H2", views="doc_lines invoice_docs", sql=STAGED + " select doc_id, field_name, value, confidence, stage_no from chosen")
def staged_fields(t):
    return staged(t).fields


@query("C1 X15", views="doc_lines invoice_docs", sql=STAGED + """
select 1 as stage_no, count(*) as opened, count(*) filter (where last_stage = 1) as closed from lasts
union all select 2, count(*), count(*) filter (where last_stage = 2) from lasts where last_stage >= 2 having count(*) > 0
union all select 3, count(*), count(*) filter (where doc_id not in (select w.doc_id from want w left join chosen c using (doc_id, field_name) where coalesce(c.confidence, 0) <= 0.8))
  from lasts where last_stage = 3 having count(*) > 0""")
def staged_counts(t):
    """Documents that each stage saw and closed."""
    return staged(t).stages


@query("C1 X33 X42", views="doc_lines invoice_docs", sql=STAGED + ",\n" + CHECKS + """,
r as (select l.doc_id, (count(*) filter (where field_name = 'total_amount') = 0)::int + (count(*) filter (where field_name = 'vendor_name' and length(value) > 12) > 0)::int
  + (max(type) = 'receipt' and count(*) filter (where field_name = 'payment_method' and coalesce(try_cast(value as decimal(28,6)) < 100, true)) > 0)::int as broken
  from lasts l left join chosen c using (doc_id) group by l.doc_id),
x as (select doc_id, count(*) as bad_ids from chosen where field_name = 'tax_id' and length(value) <> 13 group by doc_id),
j as (select l.*, coalesce(g.fields, 0) as fields, coalesce(bad, 0) + coalesce(bad_ids, 0) + coalesce((abs(s + v - t) > 0.05)::int, 0) as invalid_count, broken as broken_rules, coalesce(mean_confidence, 0.0) as mean_confidence
  from lasts l join r using (doc_id) left join g using (doc_id) left join x using (doc_id))
select *, invalid_count = 0 and broken_rules = 0 as overall_valid,
  case when mean_confidence < 0.8 or invalid_count > 0 or broken_rules > 0 then 'needs_review' else 'completed' end as status from j""")
def staged_documents(t):
    return SG.reported(staged(t), JOB_RULES, "2024-06-30").select(
        "doc_id", "type", "last_stage", "fields", "invalid_count", F.col("broken_rules"), "mean_confidence", "overall_valid", "status")
