"""Field checks, document reports, rule tables and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.normalize import (
    AMOUNT, FIELD_TYPES, SCORE, amount_errors, amount_text, check_field, clean_amount, date_of_parts, date_parts, date_problem, date_text,
    digits_only, field_type, integer_text, parse_amount, parse_clean_amount, resolve_mismatch, tax_id_problem,
)

AMOUNT_NAMES = ["subtotal", "vat", "total_amount"]


def wide_fields(fields: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per document, one column per listed field; the later row wins."""
    return fields.where(F.col("field_name").isin(list(names))).groupBy("doc_id").pivot("field_name", list(names)).agg(
        F.max_by("field_value", "field_id"))


def check_values(values: DataFrame, today: str, weights: int = 12) -> DataFrame:
    """Check of ``field_value`` as ``kind`` (date, currency, tax_id, integer, text); adds the result columns."""
    v, k = F.col("field_value"), F.col("kind")
    number = k.isin("tax_id", "integer")
    step = values.withColumns({
        "__d": F.when(k == "date", date_text(v)), "__a": F.when(k == "currency", clean_amount(v)), "__digits": F.when(number, digits_only(v))})
    parts = {f"__p{i}": F.when(k == "date", p) for i, p in enumerate(date_parts(F.col("__d")))}
    step = step.withColumns({**parts, "__amount": parse_clean_amount(F.col("__a")), "__whole": integer_text(v, F.col("__digits"))})
    step = step.withColumn("__day", F.when(k == "date", date_of_parts([F.col(p) for p in parts])))
    step = step.withColumns({
        "__day_issue": date_problem(F.col("__day.value"), F.lit(today).cast("date")),
        "__tax_issue": F.when(k == "tax_id", tax_id_problem(v, weights, F.col("__digits")))})
    result = check_field(v, k, *[F.col(f"__{n}") for n in ("day", "amount", "digits", "whole", "day_issue", "tax_issue")])
    return step.withColumn("__r", result).select(*values.columns, "__r.*")


def checked_fields(fields: DataFrame, today: str, known_only: bool = True) -> DataFrame:
    """Check of every known header field that is present, with the lowered confidence; other fields count as text."""
    known = fields.where(F.col("field_value").isNotNull())
    if known_only:
        known = known.where(F.col("field_name").isin(list(FIELD_TYPES)))
    out = check_values(known.withColumn("kind", field_type("field_name")), today)
    new = F.greatest(F.lit(0).cast(SCORE), F.col("confidence").cast(SCORE) - F.col("adjustment")).cast(SCORE)
    return out.withColumn("adjusted_confidence", F.when(F.col("adjustment") > 0, new).otherwise(F.col("confidence")))


def _named(name: str, value: Column) -> Column:
    return F.max(F.when(F.col("field_name") == name, value))


_REPORT_COLUMNS = {"doc_id", "validation_count", "valid_count", "field_issues", "adj", "bad_fields", *AMOUNT_NAMES,
                   *[f"{n}_conf" for n in AMOUNT_NAMES]}


def validation_report(checked: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Per document: counts, amount relation, mean adjustment, fields to review and the likely fix of a mismatch.

    Only the listed header fields reach this point, so the list of names stays short.
    """
    amount = F.col("__amount")
    checked = checked.withColumn("__clean", F.when(F.col("field_name").isin(AMOUNT_NAMES), clean_amount("normalized_value"))).withColumn(
        "__amount", parse_clean_amount(F.col("__clean")))
    agg = checked.groupBy("doc_id").agg(
        F.count("*").alias("validation_count"), F.count_if("is_valid").alias("valid_count"),
        F.count_if(~F.col("is_valid")).alias("field_issues"),
        F.sum(F.col("adjustment").cast(SCORE)).cast("double").alias("adj"),
        F.sort_array(F.collect_set(F.when(~F.col("is_valid"), F.col("field_name")))).alias("bad_fields"),
        *[_named(n, amount).alias(n) for n in AMOUNT_NAMES],
        *[_named(n, F.col("confidence")).alias(f"{n}_conf") for n in AMOUNT_NAMES], *extra,
    )
    kept = [c for c in agg.columns if c not in _REPORT_COLUMNS]
    sub, vat, total = (F.col(n) for n in AMOUNT_NAMES)
    mismatch = F.size(amount_errors(sub, vat, total)) > 0
    agg = agg.withColumn("mismatch", mismatch)
    guess = resolve_mismatch(sub, F.coalesce(vat, F.lit(0).cast(AMOUNT)), total, {n: F.col(f"{n}_conf") for n in AMOUNT_NAMES})
    more = F.col("mismatch").cast("int")
    return agg.withColumn("guess", F.when(F.col("mismatch"), guess)).select(
        "doc_id", "validation_count", "valid_count", (F.col("field_issues") + more).alias("invalid_count"),
        (F.col("field_issues") + more).alias("needs_review_count"),
        F.array_join(F.concat("bad_fields", F.when(F.col("mismatch"), F.array(F.lit("amount_relationship")))
                              .otherwise(F.array().cast("array<string>"))), ",").alias("fields_needing_review"),
        (F.col("adj") / F.greatest("validation_count", F.lit(1))).alias("confidence_adjustment"),
        ((F.col("field_issues") == 0) & ~F.col("mismatch")).alias("overall_valid"),
        F.col("guess.target").alias("suggested_field"), amount_text(F.col("guess.value")).alias("suggested_value"), *kept)


def validation_statistics(report: DataFrame) -> DataFrame:
    """Totals, mean and exact median adjustment. The median runs over counted distinct values."""
    counted = report.groupBy(F.col("confidence_adjustment").alias("a")).agg(
        F.count("*").alias("n"), F.sum("validation_count").alias("fields"), F.sum("valid_count").alias("valid"),
        F.sum("invalid_count").alias("invalid"))
    return counted.agg(
        F.sum("n").alias("documents"), F.sum("fields").alias("fields"), F.sum("valid").alias("valid_fields"),
        F.sum("invalid").alias("invalid_fields"),
        (F.sum((F.col("a") * F.col("n")).cast("decimal(28,8)")).cast("double") / F.sum("n")).alias("mean_adjustment"),
        F.percentile("a", 0.5, F.col("n")).alias("median_adjustment"))


def validation_by_type(checked: DataFrame) -> DataFrame:
    return checked.groupBy("kind").agg(
        F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))


@dataclass(frozen=True)
class FieldRule:
    """kind: required, pattern (regex), min_length, max_length, min or max (numbers)."""

    field: str
    kind: str
    value: object = None
    message: str = ""


def _violates(rule: FieldRule) -> Column:
    v = F.col(rule.field)
    empty = v.isNull() | (v == "")
    if rule.kind == "required":
        return empty
    tests = {
        "pattern": lambda: ~v.rlike(str(rule.value)), "min_length": lambda: F.length(v) < rule.value,
        "max_length": lambda: F.length(v) > rule.value,
        "min": lambda: F.coalesce(v.try_cast("decimal(28,6)") < F.lit(str(rule.value)).cast("decimal(28,6)"), F.lit(True)),
        "max": lambda: F.coalesce(v.try_cast("decimal(28,6)") > F.lit(str(rule.value)).cast("decimal(28,6)"), F.lit(True)),
    }
    return ~empty & tests[rule.kind]()


def rule_issues(wide: DataFrame, rules: Mapping[str, Sequence[FieldRule]], type_column: str = "type") -> DataFrame:
    """Issue rows of declared rules per document type; ``*`` rules hold for every type."""
    found = []
    for doc_type, type_rules in rules.items():
        applies = F.lit(True) if doc_type == "*" else F.col(type_column) == doc_type
        for r in type_rules:
            found.append(F.when(applies & _violates(r), F.struct(
                F.lit(r.field).alias("field_name"), F.lit(r.kind).alias("rule"),
                F.lit(r.message or f"{r.field} fails {r.kind}").alias("message"))))
    issues = F.filter(F.array(*found), lambda x: x.isNotNull())
    return wide.select("doc_id", F.inline(issues))


# Fields that must be there per type.
MANDATORY = {"invoice": ["invoice_number", "total_amount"], "receipt": ["total_amount"]}

# Fields to extract per type; other types use the invoice list.
SUPPORTED_FIELDS = {
    "invoice": ["invoice_number", "invoice_date", "vendor_name", "total_amount", "tax_id", "subtotal", "vat"],
    "receipt": ["receipt_number", "date", "vendor", "total_amount", "payment_method"],
}


def mandatory_check(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document: does it have the fields its type must have?"""
    names = sorted({n for ns in MANDATORY.values() for n in ns})
    have = fields.where(F.col("field_name").isin(names) & (F.col("field_value") != "")).groupBy("doc_id").agg(
        *[F.coalesce(F.bool_or(F.col("field_name") == n), F.lit(False)).alias(n) for n in names])
    ok = F.lit(True)
    for t, needed in MANDATORY.items():
        for n in needed:
            ok = ok & ((F.col("type") != t) | F.coalesce(n, F.lit(False)))
    return docs.select("doc_id", "type").join(have, "doc_id", "left").select("doc_id", "type", ok.alias("is_complete"))


def field_lists(kind: Column, definitions: DataFrame) -> Column:
    """Field lists of a type, one per active definition (name, fields_schema JSON), else the built-in list.

    The definitions, a row per type, are looked up as one value, so no document is moved for them.
    """
    built_in = F.create_map(*[x for t, ns in SUPPORTED_FIELDS.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in ns]))])

    def default(of):
        return F.coalesce(F.try_element_at(built_in, of), F.array(*[F.lit(n) for n in SUPPORTED_FIELDS["invoice"]]))

    defined = F.coalesce(F.from_json("fields_schema", "array<string>"), default(F.col("name")))
    d = definitions.where("active and name is not null").groupBy("name").agg(F.collect_list(defined).alias("lists"))
    table = d.agg(F.map_from_entries(F.collect_list(F.struct("name", "lists")))).scalar()
    return F.coalesce(F.try_element_at(table, kind), F.array(default(kind)))


def fields_to_extract(docs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Field list per document: the active definition of its type, else the built-in list."""
    return docs.select("doc_id", "type", F.explode(field_lists(F.col("type"), definitions)).alias("fields"))


def audit_issues(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Consistency issues: amounts that do not add up (with the likely fix) and missing mandatory fields."""
    names = [*AMOUNT_NAMES, "invoice_number"]
    amount = parse_amount(F.col("field_value"))
    f = fields.where(F.col("field_name").isin(names)).groupBy("doc_id").agg(
        *[_named(n, amount).alias(n) for n in AMOUNT_NAMES],
        *[_named(n, F.col("confidence")).alias(f"{n}_conf") for n in AMOUNT_NAMES],
        *[F.coalesce(F.bool_or((F.col("field_name") == n) & (F.col("field_value") != "")), F.lit(False)).alias(f"has_{n}")
          for n in ("invoice_number", "total_amount")])
    sub, vat, total = (F.col(n) for n in AMOUNT_NAMES)
    j = docs.select("doc_id", "type").join(f, "doc_id", "left")
    j = j.withColumn("guess", F.when(
        F.size(amount_errors(sub, vat, total)) > 0,
        resolve_mismatch(sub, F.coalesce(vat, F.lit(0).cast(AMOUNT)), total, {n: F.col(f"{n}_conf") for n in AMOUNT_NAMES})))
    issues = [F.when(F.col("guess").isNotNull(), F.struct(
        F.col("guess.target").alias("field_name"), F.lit("logical_inconsistency").alias("issue_type"),
        F.lit("high").alias("severity"), amount_text(F.col("guess.value")).alias("suggested_fix")))]
    for t, needed in MANDATORY.items():
        for n in needed:
            missing = (F.col("type") == t) & ~F.coalesce(F.col(f"has_{n}"), F.lit(False))
            issues.append(F.when(missing, F.struct(
                F.lit(n).alias("field_name"), F.lit("missing_logic").alias("issue_type"),
                F.lit("medium").alias("severity"), F.lit(None).cast("string").alias("suggested_fix"))))
    return j.select("doc_id", F.inline(F.filter(F.array(*issues), lambda x: x.isNotNull())))


def confidence_score_issues(fields: DataFrame) -> DataFrame:
    """Per document: scores outside [0, 1]. Counts in one aggregate, the bad ones stay as rows (``bad_scores``)."""
    bad = ~F.col("confidence").between(0, 1)
    return fields.where(F.col("confidence").isNotNull()).groupBy("doc_id").agg(
        F.count("*").alias("scores"), F.count_if(bad).alias("invalid_scores"), (F.count_if(bad) == 0).alias("is_valid"))


def bad_scores(fields: DataFrame) -> DataFrame:
    return fields.where(~F.col("confidence").between(0, 1)).select("doc_id", "field_name", "confidence")
