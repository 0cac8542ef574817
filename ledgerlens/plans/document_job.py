"""The batch document job: classify, extract, check, route, report; and its write-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.classify import pattern_classify
from ledgerlens.functions.confidence import mean
from ledgerlens.operators import extraction, layout, routing, validation
from ledgerlens.schemas import HEADER_FIELDS


def extracted(docs: DataFrame, today: str, keep: tuple[str, ...] = ("type",)) -> DataFrame:
    """Checked fields of documents (doc_id, text, lines), long form; the type comes from the text."""
    typed = docs.withColumn("type", pattern_classify("text"))
    chosen = extraction.chosen_headers(typed, HEADER_FIELDS, keep)
    fields = chosen.withColumnRenamed("value", "field_value").withColumn(
        "field_id", F.xxhash64("doc_id", "field_name"))
    return validation.checked_fields(fields, today, known_only=False)


def routed(fields: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document: report, mean confidence, status and reason. Same key as the text: no further shuffle."""
    report = validation.validation_report(
        fields, [mean("confidence").alias("mean_confidence"), F.max("type").alias("type"), F.count("*").alias("fields")])
    return routing.straight_through(report, threshold)


def process(lines: DataFrame, today: str, threshold: float = 0.8) -> DataFrame:
    return routed(extracted(extraction.document_text(lines), today), threshold)


def run(lines: DataFrame, boxes: DataFrame, today: str, out: str, threshold: float = 0.8) -> None:
    """Write fields, table cells and document results. The fields are written once and read back, not computed twice."""
    spark = lines.sparkSession
    extracted(extraction.document_text(lines), today).write.mode("overwrite").parquet(f"{out}/fields")
    layout.table_cells(boxes).write.mode("overwrite").parquet(f"{out}/table_cells")
    routed(spark.read.parquet(f"{out}/fields"), threshold).write.mode("overwrite").parquet(f"{out}/documents")


def extract_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Ad-hoc form: type, fields and confidences of texts, nothing stored."""
    d = extraction.lines_of(docs, text).withColumn("type", pattern_classify(text))
    return extraction.chosen_headers(d, HEADER_FIELDS, ("type",))
