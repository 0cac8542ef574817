"""Accuracy and calibration out of corrected fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.normalize import SCORE


def field_accuracy(fields: DataFrame, since: str | None = None) -> DataFrame:
    """Per field name: extractions, corrections, accuracy, mean confidence (null counts 0), their difference."""
    if since:
        fields = fields.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    conf = F.coalesce(F.col("confidence").cast(SCORE), F.lit(0).cast(SCORE))
    agg = fields.groupBy("field_name").agg(
        F.count("*").alias("total_extractions"),
        F.count_if("is_corrected").alias("corrected_count"),
        F.sum(conf).cast("double").alias("conf_sum"))
    total = F.col("total_extractions")
    return agg.select(
        "field_name", "total_extractions", "corrected_count",
        ((total - F.col("corrected_count")) / total).alias("accuracy"),
        (F.col("conf_sum") / total).alias("avg_confidence"),
    ).withColumn("calibration_error", F.col("avg_confidence") - F.col("accuracy"))


def over_confident(report: DataFrame, error: float = 0.3, min_total: int = 10) -> DataFrame:
    """Fields that are sure and wrong, with the advice as text."""
    return report.where((F.col("calibration_error") > error) & (F.col("total_extractions") > min_total)).select(
        "field_name", "total_extractions",
        F.concat(
            F.lit("Field '"), "field_name", F.lit("' is over-confident: confidence "),
            F.format_string("%.2f", "avg_confidence"), F.lit(" against accuracy "), F.format_string("%.2f", "accuracy"),
            F.lit(". Consider stricter validation.")).alias("suggestion"))


def calibrated_threshold(report: DataFrame, current: float = 0.7, error: float = 0.2, step: float = 0.05, top: float = 0.95) -> DataFrame:
    """New extraction threshold: one step per over-confident field, at most ``top``."""
    steps = F.count_if(F.col("calibration_error") > error)
    raised = F.least(F.lit(top).cast("decimal(6,2)"), F.lit(current).cast("decimal(6,2)") + steps * F.lit(step).cast("decimal(6,2)"))
    return report.agg(raised.cast("double").alias("extraction_threshold"), steps.alias("raised_by"),
                      F.count("*").alias("fields_analyzed"))


def field_sets(fields: DataFrame) -> DataFrame:
    """Per document its distinct field names, sorted."""
    return fields.groupBy("doc_id").agg(F.sort_array(F.collect_set("field_name")).alias("fields"))


def template_suggestions(fields: DataFrame, definitions: DataFrame | None = None, min_docs: int = 3) -> DataFrame:
    """Field sets shared by at least ``min_docs`` documents and not yet defined (``definitions.fields``)."""
    groups = field_sets(fields).groupBy("fields").agg(F.count("*").alias("evidence_count")).where(
        F.col("evidence_count") >= min_docs)
    if definitions is not None:
        groups = groups.join(definitions.select(F.sort_array(F.array_distinct("fields")).alias("fields")), "fields", "left_anti")
    return groups


def field_overlap(fields: DataFrame, reference: list[str]) -> DataFrame:
    """Each document's field set against a reference set: shared, missing, extra, equal."""
    ref = F.sort_array(F.array(*[F.lit(x) for x in reference]))
    f = F.col("fields")
    return field_sets(fields).select(
        "doc_id", F.size(F.array_intersect(f, ref)).alias("shared"), F.size(F.array_except(ref, f)).alias("missing"),
        F.size(F.array_except(f, ref)).alias("extra"), (f == ref).alias("same_set"))
