"""The document job as a chain of stages that stop early.

A type decides which fields are wanted (its active definition, else the built-in list). Stages run one after the other on the documents
that are still open: labels, anchors, then models of the user. What a stage closes, later stages do not see. Then come the checks: value
checks, the rules declared per type, table cells by document, and the routing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import hooks
from ledgerlens.functions.classify import pattern_classify
from ledgerlens.functions.confidence import mean
from ledgerlens.functions.normalize import SCORE
from ledgerlens.operators import extraction, layout, routing, validation
from ledgerlens.operators.extraction import STAGES
from ledgerlens.schemas import HEADER_FIELDS
from ledgerlens.session import written

#: Results of all documents: doc_id, field_name, value, confidence, stage_no.
FOUND = ["doc_id", "field_name", "value", "confidence", "stage_no"]


@dataclass(frozen=True)
class Stage:
    """``extract``: open documents (doc_id, type, text, lines, fields) -> doc_id, field_name, value, confidence.

    ``enough`` tells from n (wanted fields), found and sure (found with more than 0.8) whether a document is closed. A result counts above
    ``least``.
    """

    no: int
    extract: Callable[[DataFrame], DataFrame]
    enough: Callable[[Column, Column, Column], Column]
    least: float


def label_stage() -> Stage:
    """Closed when 70 % of the wanted fields are sure."""
    return Stage(1, lambda d: extraction.label_results(d, HEADER_FIELDS), lambda n, found, sure: 10 * sure >= 7 * n, STAGES[1][1])


def anchor_stage() -> Stage:
    """Closed when all wanted fields are there."""
    return Stage(2, lambda d: extraction.best_candidates(extraction.anchor_candidates(d, HEADER_FIELDS)), lambda n, found, sure: found >= n, STAGES[2][1])


def model_stage(model: Callable[[pd.DataFrame], pd.DataFrame], no: int = 3) -> Stage:
    """A user model over Arrow batches of open documents; closed when all wanted fields are sure."""
    return Stage(no, lambda d: hooks.model_stage(d.select("doc_id", "type", "text", "fields"), model), lambda n, found, sure: sure >= n, STAGES[no][1])


@dataclass(frozen=True)
class Staged:
    fields: DataFrame  # doc_id, field_name, value, confidence, stage_no: the best result of each wanted field
    stages: DataFrame  # stage_no, opened, closed: documents that each stage saw and closed
    documents: DataFrame  # doc_id, type, last_stage


def prepared(docs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lines) with their type, classified by the text unless they have one, and wanted fields.

    An id with several documents or definitions has a row for each document and list.
    """
    kind = F.col("type") if "type" in docs.columns else pattern_classify("text")
    typed = docs.where("doc_id is not null").select("doc_id", "text", "lines", kind.alias("type"))
    own = typed.withColumn("lists", validation.field_lists(F.col("type"), definitions))
    every = F.flatten(F.collect_list("lists").over(Window.partitionBy("doc_id")))
    return own.withColumn("lists", every).select("doc_id", "text", "lines", "type", F.explode("lists").alias("fields"))


RESULT = f"struct<field_name string, value string, confidence {SCORE}, stage_no int>"


def best_results(held: Column, more: Column) -> Column:
    """The best of several results per field: the highest confidence, then the earlier stage."""
    both = F.concat(held, more)

    def best(name):
        ranked = F.transform(F.filter(both, lambda r: r["field_name"] == name), lambda r: F.struct(
            r["confidence"].alias("confidence"), (-r["stage_no"]).alias("turn"), r["value"].alias("value")))
        return F.array_max(ranked)

    def found(name):
        b = best(name)
        return F.struct(name.alias("field_name"), b["value"].alias("value"), b["confidence"].alias("confidence"), (-b["turn"]).alias("stage_no"))

    return F.transform(F.array_distinct(F.transform(both, lambda r: r["field_name"])), found)


def extract(docs: DataFrame, stages: Sequence[Stage]) -> Staged:
    """Runs the stages over prepared documents with unique ids.

    A later result replaces an earlier one only with a higher confidence. The texts are written once, and after each stage one row per document with
    its best results. Documents that a stage closed are taken out by an anti join, so a costly stage reads open documents only.

    That row holds ``copies`` (type and wanted fields, several if the id came several times), ``best`` (the best results), ``closed_at`` (the stage that
    closed it, else null) and ``closings`` (copies that it closed).
    """
    docs = written(docs, "documents")
    state = None
    none = F.array().cast(f"array<{RESULT}>")
    for stage in stages:
        open_docs = docs if state is None else docs.join(state.where("closed_at is not null").select("doc_id"), "doc_id", "left_anti")
        results = stage.extract(open_docs).select("doc_id", F.struct(
            "field_name", "value", F.col("confidence").cast(SCORE).alias("confidence"), F.lit(stage.no).alias("stage_no")).cast(RESULT).alias("r")).where(
            (F.col("r.confidence") > stage.least) & F.col("doc_id").isNotNull())
        if state is None:  # documents and results meet in one shuffle
            copies = docs.select("doc_id", F.struct("type", "fields").alias("copy"), F.lit(None).cast(RESULT).alias("r"))
            both = copies.unionByName(results.select("doc_id", F.lit(None).cast(copies.schema["copy"].dataType).alias("copy"), "r"))
            state = both.groupBy("doc_id").agg(F.collect_list("copy").alias("copies"), F.collect_list("r").alias("new")).where(F.size("copies") > 0).withColumns(
                {"best": none, "closed_at": F.lit(None).cast("int"), "closings": F.lit(0)})
        else:
            state = state.join(results.groupBy("doc_id").agg(F.collect_list("r").alias("new")), "doc_id", "left")
        is_open = F.col("closed_at").isNull()
        wanted = F.array_distinct(F.flatten(F.col("copies.fields")))
        state = state.withColumn("wanted", wanted).withColumn("new", F.filter(F.coalesce("new", none), lambda r: F.array_contains("wanted", r["field_name"])))
        state = state.withColumn("best", F.when(is_open & (F.size("new") > 0), best_results(F.col("best"), F.col("new"))).otherwise(F.col("best")))
        state = state.withColumns({"found": F.size("best"), "sure": F.size(F.filter("best", lambda r: r["confidence"] > 0.8))})
        done = F.size(F.filter("copies", lambda c: stage.enough(F.size(F.array_distinct(c["fields"])), F.col("found"), F.col("sure"))))
        state = state.withColumn("done", F.when(is_open, done).otherwise(0))
        state = written(state.select(
            "doc_id", "copies", "best", F.when(F.col("done") > 0, stage.no).otherwise(F.col("closed_at")).alias("closed_at"),
            F.when(F.col("done") > 0, F.col("done")).otherwise(F.col("closings")).alias("closings")), "stage")
    seen = [s.no for s in stages]
    copy = F.explode(F.flatten(F.transform("copies", lambda c: F.array_repeat(c["type"], F.greatest("closings", F.lit(1)))))).alias("type")
    last = state.select("doc_id", copy, F.coalesce("closed_at", F.lit(seen[-1])).alias("last_stage"), "closed_at")
    steps = F.array(*[F.struct(F.lit(no).alias("stage_no")) for no in seen])
    reach = last.select("last_stage", "closed_at", F.inline(steps)).where(F.col("stage_no") <= F.col("last_stage"))
    counts = reach.groupBy("stage_no").agg(F.count("*").alias("opened"), F.count_if(F.col("closed_at") == F.col("stage_no")).alias("closed"))
    return Staged(state.select("doc_id", F.inline("best")).select(FOUND), counts, last.select("doc_id", "type", "last_stage"))


def rule_findings(staged: Staged, rules: Mapping[str, Sequence[validation.FieldRule]]) -> DataFrame:
    """doc_id, field_name, rule, message: broken rules of the documents' types; a missing field breaks ``required``."""
    names = sorted({r.field for rs in rules.values() for r in rs})
    wide = staged.fields.where(F.col("field_name").isin(names)).groupBy("doc_id").pivot("field_name", names).agg(F.max("value"))
    return validation.rule_issues(staged.documents.select("doc_id", "type").join(wide, "doc_id", "left"), rules)


def document_cells(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Table cells with the document that their page belongs to (pages: page_id, doc_id)."""
    return layout.table_cells(boxes).join(pages.select("page_id", "doc_id"), "page_id")


def reported(staged: Staged, rules: Mapping[str, Sequence[validation.FieldRule]], today: str, threshold: float = 0.8) -> DataFrame:
    """One row per document: type, last stage, counts, mean confidence, status and reason.

    A document without any field has no mean, and is one for review, like one that breaks a rule.
    """
    fields = staged.fields.join(staged.documents.select("doc_id", "type"), "doc_id").withColumnRenamed("value", "field_value").withColumn(
        "field_id", F.xxhash64("doc_id", "field_name"))
    report = validation.validation_report(
        validation.checked_fields(fields, today, known_only=False), [mean("confidence").alias("mean_confidence"), F.count("*").alias("fields")])
    broken = rule_findings(staged, rules).groupBy("doc_id").agg(F.count("*").alias("broken_rules"))
    docs = staged.documents.join(report, "doc_id", "left").join(broken, "doc_id", "left")
    docs = docs.withColumns({
        "fields": F.coalesce("fields", F.lit(0)), "broken_rules": F.coalesce("broken_rules", F.lit(0)), "invalid_count": F.coalesce("invalid_count", F.lit(0)),
        "mean_confidence": F.coalesce("mean_confidence", F.lit(0.0))})
    docs = docs.withColumn("overall_valid", F.coalesce("overall_valid", F.lit(True)) & (F.col("broken_rules") == 0))
    return routing.straight_through(docs, threshold).select(
        "doc_id", "type", "last_stage", "fields", "invalid_count", "broken_rules", "mean_confidence", "overall_valid", "status", "review_reason")


def run(
    docs: DataFrame, boxes: DataFrame, pages: DataFrame, definitions: DataFrame, rules: Mapping[str, Sequence[validation.FieldRule]], stages: Sequence[Stage],
    today: str, out: str, threshold: float = 0.8,
) -> None:
    """Writes fields, stages, broken rules, table cells by document, and document results."""
    staged = extract(prepared(docs, definitions), stages)
    frames = {
        "fields": staged.fields, "stages": staged.stages, "broken_rules": rule_findings(staged, rules), "table_cells": document_cells(boxes, pages),
        "documents": reported(staged, rules, today, threshold)}
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{out}/{name}")
