"""Field mapping and export sinks. Writers go through Spark sources; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import apply_transform, cast_ok, cast_value
from ledgerlens.skew import nested_parts, rank_in_key


@dataclass(frozen=True)
class MappingRule:
    source: str
    target: str
    data_type: str = "string"
    default: str | None = None
    required: bool = False
    transform: str | None = None


def mapped_text(rule: MappingRule, columns: Sequence[str]) -> Column:
    """Mapped value as text: default only when the document lacks the column, then the transform."""
    value = F.col(rule.source) if rule.source in columns else F.lit(rule.default).cast("string")
    return apply_transform(value, rule.transform)


def apply_mapping(wide: DataFrame, rules: Sequence[MappingRule], key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Renamed, transformed columns in rule order, as text."""
    return wide.select(key, *keep, *[mapped_text(r, wide.columns).alias(r.target) for r in rules])


def apply_typed_mapping(wide: DataFrame, rules: Sequence[MappingRule], key: str = "doc_id") -> DataFrame:
    """Typed columns (null where the text does not fit) plus ``<target>_ok``."""
    out = [F.col(key)]
    for r in rules:
        t = mapped_text(r, wide.columns)
        out += [cast_value(t, r.data_type).alias(r.target), cast_ok(t, r.data_type).alias(f"{r.target}_ok")]
    return wide.select(*out)


def map_long(fields: DataFrame, rules: Sequence[MappingRule]) -> DataFrame:
    """Mapping of long fields in one aggregation: a default applies per document that lacks the field."""
    def one(r):
        here = F.col("field_name") == r.source
        last = F.max_by(F.when(here, F.struct("field_value")), F.when(here, F.col("field_id")))
        value = F.when(last.isNull(), F.lit(r.default).cast("string")).otherwise(last["field_value"])
        return apply_transform(value, r.transform).alias(r.target)

    return fields.groupBy("doc_id").agg(*[one(r) for r in rules])


def wide_union(*frames: DataFrame) -> DataFrame:
    """Union of ragged documents with columns in sorted order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def wide_of_keys(fields: DataFrame, most: int = 5000) -> DataFrame:
    """One row per document with a column for every field name of the data, in sorted order; the later field row wins.

    Two passes: the distinct names, then a pivot with these as columns. More than ``most`` names are refused.
    """
    names = [r[0] for r in fields.where("field_name is not null").select("field_name").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} field names")
    return fields.groupBy("doc_id").pivot("field_name", sorted(names)).agg(F.max_by("field_value", "field_id")) if names else fields.select("doc_id").distinct()


def csv_frame(mapped: DataFrame) -> DataFrame:
    """Text columns with missing values as empty strings, as a CSV shows them."""
    return mapped.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in mapped.columns])


def write_csv(frame: DataFrame, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, encoding: str = "UTF-8") -> None:
    csv_frame(frame).write.mode("overwrite").options(
        sep=delimiter, quote=quote, header=str(header).lower(), encoding=encoding, emptyValue="").csv(path)


def json_documents(docs: DataFrame, mapped: DataFrame, exported_at: str) -> DataFrame:
    """One JSON object per document: id, type, mapped fields."""
    fields = F.struct(*[c for c in mapped.columns if c != "doc_id"])
    return docs.select("doc_id", "type").join(mapped, "doc_id").select(
        "doc_id", F.to_json(F.struct(
            F.col("doc_id").alias("document_id"), F.col("type").alias("document_type"), fields.alias("fields"),
            F.lit(exported_at).alias("exported_at"))).alias("json"))


def export_envelope(documents: DataFrame, export_id: str, exported_at: str) -> DataFrame:
    """Envelope of a JSON export; the documents themselves stay in the part files beside it."""
    return documents.agg(F.count("*").alias("document_count")).select(
        F.lit(export_id).alias("export_id"), F.lit("json").alias("export_format"), "document_count",
        F.lit(exported_at).alias("exported_at"))


def write_json_export(documents: DataFrame, path: str, export_id: str, exported_at: str) -> None:
    documents.select(F.col("json").alias("value")).write.mode("overwrite").text(f"{path}/documents")
    export_envelope(documents, export_id, exported_at).write.mode("overwrite").json(f"{path}/envelope")


def write_records(records: DataFrame, path: str, file_format: str = "jsonl") -> None:
    """Training records as jsonl, csv or parquet."""
    w = records.write.mode("overwrite")
    {"jsonl": w.json, "csv": lambda p: w.option("header", "true").csv(p), "parquet": w.parquet}[file_format](path)


def contiguous_items(items: DataFrame) -> DataFrame:
    """Line items (doc_id, n, ...) from 1 up to the first gap in n."""
    ns = items.where("n >= 1").select("doc_id", "n").distinct()
    ok = rank_in_key(ns, ["doc_id"], ["n"], F.floor(F.col("n") / 1000), "rn").where(F.col("rn") == F.col("n")).select("doc_id", "n")
    return items.join(ok, ["doc_id", "n"], "left_semi")


def item_columns(fields: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    """Fields named PREFIX<n>_<column> as rows (doc_id, n, columns); a number with a leading zero is none."""
    pattern = rf"^{prefix}(0|[1-9]\d*)_(.+)$"
    f = fields.select("doc_id", "field_id", "field_value", F.regexp_extract("field_name", pattern, 1).try_cast("int").alias("n"),
                      F.regexp_extract("field_name", pattern, 2).alias("c")).where(F.col("n").isNotNull() & F.col("c").isin(list(columns)))
    return f.groupBy("doc_id", "n").agg(*[
        F.max_by(F.when(F.col("c") == c, F.col("field_value")), F.when(F.col("c") == c, F.col("field_id"))).alias(c) for c in columns])


def erp_documents(mapped: DataFrame, header: Sequence[str], items: DataFrame, erp_type: str) -> DataFrame:
    """ERP documents: header struct, all fields, line items; large item lists come in several parts."""
    item = F.struct(*[c for c in items.columns if c != "doc_id"])
    nested = nested_parts(items.withColumn("__k", F.col("n")), "doc_id", "__k", item, "line_items")
    return mapped.join(nested, "doc_id", "left").select(
        "doc_id", F.lit(erp_type).alias("document_type"), F.struct(*[h for h in header if h in mapped.columns]).alias("header"),
        F.struct(*[c for c in mapped.columns if c != "doc_id"]).alias("fields"), F.coalesce("part", F.lit(0)).alias("part"), "line_items")


def erp_json(erp: DataFrame) -> DataFrame:
    return erp.select("doc_id", F.to_json(F.struct("document_type", "header", "fields", "part", "line_items")).alias("json"))


def erp_flat(mapped: DataFrame, header: Sequence[str]) -> DataFrame:
    """CSV form: header columns first, then the other fields."""
    first = [h for h in header if h in mapped.columns]
    return csv_frame(mapped.select("doc_id", *first, *[c for c in mapped.columns if c not in (*first, "doc_id")]))




def validate_export(docs: DataFrame, fields: DataFrame, rules: Sequence[MappingRule]) -> tuple[DataFrame, DataFrame]:
    """Per document counts, and issue rows: a missing required field is an error, an optional one without default a warning."""
    present = fields.where(F.col("field_name").isin([r.source for r in rules])).groupBy("doc_id").agg(
        *[F.bool_or(F.col("field_name") == r.source).alias(f"p_{i}") for i, r in enumerate(rules)])
    j = docs.select("doc_id").join(present, "doc_id", "left")
    has = [F.coalesce(f"p_{i}", F.lit(False)) for i in range(len(rules))]
    zero = F.lit(0)
    missing_required = sum(((~h & F.lit(r.required)).cast("int") for h, r in zip(has, rules)), zero)
    warn = sum(((~h & F.lit(not r.required and r.default is None)).cast("int") for h, r in zip(has, rules)), zero)
    report = j.select(
        "doc_id", F.lit(len(rules)).alias("field_count_total"), sum((h.cast("int") for h in has), zero).alias("field_count_exported"),
        missing_required.alias("errors"), warn.alias("warnings"), (missing_required == 0).alias("is_valid"))
    found = [F.when(~h, F.struct(F.lit(r.source).alias("field_name"), F.lit("error" if r.required else "warning").alias("severity")))
             for h, r in zip(has, rules) if r.required or r.default is None]
    issues = j.select("doc_id", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull()))) if found else \
        j.select("doc_id", F.lit("").alias("field_name"), F.lit("").alias("severity")).limit(0)
    return report, issues
