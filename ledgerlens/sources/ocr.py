"""OCR results as rows: external payloads, quad boxes, paged results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.geometry import ltrb_to_xywh, quad_to_xywh
from ledgerlens.schemas import EXTERNAL_PAYLOAD

QUAD_RESULTS = "array<struct<bbox:array<array<double>>,text:string,confidence:double>>"
# One page is an array of entries; an entry is [corners, [text, confidence]], kept as text until checked.
PAGED_RESULTS = "array<array<array<string>>>"


def parse_payloads(raw: DataFrame, payload: str = "payload") -> DataFrame:
    return raw.withColumn("p", F.from_json(payload, EXTERNAL_PAYLOAD)).drop(payload)


def payload_jobs(parsed: DataFrame) -> DataFrame:
    """Job state and document type and page count per payload; a failed one carries its error."""
    first = F.get("p.result", F.lit(0))
    ok = F.coalesce(F.col("p.status"), F.lit(False))
    return parsed.select(
        F.col("p.request_id").alias("request_id"), F.col("p.transaction_id").alias("transaction_id"),
        F.when(ok, "completed").otherwise("error").alias("job_status"),
        F.when(~ok, F.coalesce("p.error", F.lit("External OCR error"))).alias("error_message"),
        F.when(ok & (first["doc_type"] != ""), first["doc_type"]).alias("document_type"),
        F.when(ok, F.array_max(first["pages"])).alias("page_count"))


def payload_fields(parsed: DataFrame) -> DataFrame:
    """Fields of the first result of every good payload; box as x, y, width, height."""
    good = parsed.where(F.col("p.status") & (F.size("p.result") > 0))
    f = good.select(F.col("p.request_id").alias("request_id"), F.explode(F.get("p.result", F.lit(0))["data"]).alias("field_name", "f"))
    b = F.col("f.bbox")
    return f.select("request_id", "field_name", F.col("f.page").alias("page_number"), F.col("f.value").alias("field_value"),
                    ltrb_to_xywh(b["left"], b["top"], b["right"], b["bottom"]).alias("b")).select(
        "request_id", "field_name", "page_number", "field_value", "b.*")


def resolve_jobs(payloads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job of a payload: by request_id, else by transaction_id. Null when neither is known."""
    by_request = jobs.where(F.col("request_id").isNotNull()).select("request_id", F.col("job_id").alias("__r"))
    by_tx = jobs.where(F.col("transaction_id").isNotNull()).select("transaction_id", F.col("job_id").alias("__t"))
    return payloads.join(by_request, "request_id", "left").join(by_tx, "transaction_id", "left").withColumn(
        "job_id", F.coalesce("__r", "__t")).drop("__r", "__t")


def quad_fields(raw: DataFrame, results: str = "results") -> DataFrame:
    """Fields ``text_<i>`` of quad-box results (JSON array per document)."""
    r = raw.select("doc_id", F.posexplode(F.from_json(results, QUAD_RESULTS)).alias("i", "r"))
    return r.select(
        "doc_id", F.concat(F.lit("text_"), F.col("i").cast("string")).alias("field_name"), F.col("r.text").alias("field_value"),
        F.col("r.confidence").alias("confidence"), F.lit(1).alias("page_number"), quad_to_xywh(F.col("r.bbox")).alias("b")).select(
        "doc_id", "field_name", "field_value", "confidence", "page_number", "b.*")


def paged_fields(raw: DataFrame, results: str = "results") -> DataFrame:
    """Fields of paged results: short entries are skipped, one running index over all pages of a document.

    The text of an entry is parsed once, in its array, since it tells whether the entry counts; its corners are parsed once, in its row.
    """
    pages = F.from_json(results, PAGED_RESULTS)

    def entry(e, page):
        return F.struct((page + 1).alias("page_number"), F.get(e, F.lit(0)).alias("corners"), F.from_json(F.get(e, F.lit(1)), "array<string>").alias("text"))

    flat = F.flatten(F.transform(pages, lambda p, i: F.transform(
        F.filter(F.coalesce(p, F.array().cast("array<array<string>>")), lambda e: F.size(e) >= 2), lambda e: entry(e, i))))
    rows = raw.select("doc_id", F.posexplode(F.filter(flat, lambda e: F.size(e["text"]) >= 1)).alias("i", "e"))
    rows = rows.select("doc_id", "i", "e.page_number", "e.text", F.from_json("e.corners", "array<array<double>>").alias("quad"))
    return rows.select(
        "doc_id", F.concat(F.lit("text_"), F.col("i").cast("string")).alias("field_name"), F.trim(F.get("text", F.lit(0))).alias("field_value"),
        F.get("text", F.lit(1)).try_cast("double").alias("confidence"), "page_number", quad_to_xywh(F.col("quad")).alias("b")).select(
        "doc_id", "field_name", "field_value", "confidence", "page_number", "b.*")
