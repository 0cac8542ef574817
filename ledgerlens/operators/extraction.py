"""Header extraction over documents, stage choice and its statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import header
from ledgerlens.functions.normalize import SCORE, clean_amount, parse_clean_amount
from ledgerlens.schemas import HEADER_FIELDS

# Stage order and the confidence a stage's result must exceed.
STAGES = {1: ("template", 0.5), 2: ("regex", 0.4), 3: ("ml", 0.5), 4: ("llm", 0.6)}


def document_text(lines: DataFrame) -> DataFrame:
    """Documents out of OCR lines: ``lines`` in order and ``text`` joined by line breaks."""
    d = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    d = d.select("doc_id", F.col("l.text").alias("lines"))
    return d.withColumn("text", F.array_join("lines", "\n"))


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("lines", F.split(F.col(text), "\n"))


def _with_labels(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds ``l_<field>`` results of the label stage. Every step is a projection of its own: one regex per field."""
    money = [f for f in fields if f in header.AMOUNT_FIELDS]
    d = docs.withColumns({f"f_{f}": header.label_text(F.col("text"), f) for f in fields})
    if money:  # one expression for all of them, else the compiled method passes what the JVM compiles
        d = d.withColumn("money", F.transform(F.array(*[clean_amount(f"f_{f}") for f in money]), parse_clean_amount))
    d = d.withColumns({f"v_{f}": header.label_value(F.col(f"f_{f}"), F.get("money", F.lit(money.index(f))) if f in money else None, f) for f in fields})
    return d.select(*docs.columns, *[header.label_result(F.col(f"v_{f}")).alias(f"l_{f}") for f in fields])


def _with_anchors(docs: DataFrame, fields: Sequence[str], above: float | None = None) -> DataFrame:
    """Adds ``a_<field>`` results of the anchor stage; with ``above`` only where the label result is not above it."""
    d = docs.withColumn("lower", F.transform("lines", F.lower))

    def stage(f):
        hit = header.by_anchor(F.col("lines"), F.col("lower"), f)
        return hit if above is None else F.when(~F.coalesce(F.col(f"l_{f}.confidence") > above, F.lit(False)), hit)

    return d.withColumns({f"a_{f}": stage(f) for f in fields}).drop("lower")


def header_results(docs: DataFrame, fields: Sequence[str] = HEADER_FIELDS) -> DataFrame:
    """All stage results, long form: doc_id, field_name, stage_no, stage, value, confidence.

    Anchors run only where the label result is weak.
    """
    d = _with_anchors(_with_labels(docs.select("doc_id", "text", "lines"), fields), fields, STAGES[1][1])
    rows = F.array(*[
        F.struct(F.lit(f).alias("field_name"), F.lit(no).alias("stage_no"), F.lit(STAGES[no][0]).alias("stage"),
                 F.col(f"{p}_{f}.value").alias("value"), F.col(f"{p}_{f}.confidence").alias("confidence"))
        for f in fields for no, p in ((1, "l"), (2, "a"))])
    return d.select("doc_id", F.inline(F.filter(rows, lambda r: r["value"].isNotNull())))


def chosen_headers(docs: DataFrame, fields: Sequence[str] = HEADER_FIELDS, keep: Sequence[str] = ()) -> DataFrame:
    """First stage result that passes its threshold, chosen inside the document's row: no shuffle."""
    d = _with_anchors(_with_labels(docs.select("doc_id", *keep, "text", "lines"), fields), fields, STAGES[1][1])

    def pick(f):
        def as_result(no, p):
            return F.struct(F.lit(f).alias("field_name"), F.lit(no).alias("stage_no"), F.col(f"{p}_{f}.value").alias("value"),
                            F.col(f"{p}_{f}.confidence").alias("confidence"))
        return F.when(F.col(f"l_{f}.confidence") > STAGES[1][1], as_result(1, "l")).when(
            F.col(f"a_{f}.confidence") > STAGES[2][1], as_result(2, "a"))

    return d.select("doc_id", *keep, F.inline(F.filter(F.array(*[pick(f) for f in fields]), lambda r: r.isNotNull())))


def _single_stage(d: DataFrame, prefix: str, fields: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{prefix}_{f}.value").alias("value"),
                              F.col(f"{prefix}_{f}.confidence").alias("confidence")) for f in fields])
    return d.select("doc_id", F.inline(F.filter(rows, lambda r: r["value"].isNotNull())))


def anchor_results(docs: DataFrame, fields: Sequence[str] = HEADER_FIELDS) -> DataFrame:
    """Anchor stage alone for every field."""
    return _single_stage(_with_anchors(docs.select("doc_id", "lines"), fields), "a", fields)


def label_results(docs: DataFrame, fields: Sequence[str] = HEADER_FIELDS) -> DataFrame:
    """Template stage alone for every field."""
    return _single_stage(_with_labels(docs.select("doc_id", "text"), fields), "l", fields)


def anchor_candidates(docs: DataFrame, fields: Sequence[str] = HEADER_FIELDS) -> DataFrame:
    """Every value behind every anchor, long form: doc_id, field_name, value, confidence, line_no, anchor_no (both from 0).

    Lines become rows, then the anchors they hold, so that no search runs inside an array: only a hit without a value of its own looks
    at the lines behind it.
    """
    d = docs.select("doc_id", "lines", F.posexplode("lines").alias("line_no", "line")).withColumn("low", F.lower("line"))
    d = d.select("*", F.inline(header.anchor_table(fields))).where(F.contains("low", F.col("word")))
    rest = F.substr(F.col("line"), F.instr("low", F.col("word")) + F.length("word"))
    name = F.col("field_name")
    d = d.select("doc_id", "lines", "line_no", "field_name", F.col("turn").alias("anchor_no"), header.shaped_value(rest, name, fields).alias("own"))
    behind = F.filter(F.transform(F.slice("lines", F.col("line_no") + 2, header.WINDOW), lambda t, i: F.struct(
        header.shaped_value(t, name, fields).alias("value"), (i + 1).alias("distance"))), lambda v: v["value"] != "")
    own = F.struct(F.col("own").alias("value"), F.lit(0).alias("distance"))
    d = d.withColumn("v", F.when(F.col("own") != "", own).otherwise(F.get(behind, F.lit(0)))).where("v is not null")
    return d.select("doc_id", "field_name", "v.value", header.anchor_confidence(F.col("v.value"), F.col("v.distance")).alias("confidence"), "line_no", "anchor_no")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Best of many candidates per (document, field): confidence, then earlier line, then earlier anchor."""
    order = F.struct("confidence", -F.col("line_no"), -F.col("anchor_no"))
    return candidates.groupBy("doc_id", "field_name").agg(
        F.max_by(F.struct("value", "confidence", "line_no", "anchor_no"), order).alias("b")).select("doc_id", "field_name", "b.*")


def choose_stage(results: DataFrame) -> DataFrame:
    """First stage whose result passes that stage's threshold, per (document, field)."""
    passed = F.lit(False)
    for no, (_, least) in STAGES.items():
        passed = passed | ((F.col("stage_no") == no) & (F.col("confidence") > least))
    return results.where(passed).groupBy("doc_id", "field_name").agg(
        F.min_by(F.struct("stage_no", "stage", "value", "confidence"), "stage_no").alias("b")).select("doc_id", "field_name", "b.*")


def final_stage(results: DataFrame) -> DataFrame:
    """Latest stage with any result per document."""
    return results.groupBy("doc_id").agg(F.max("stage_no").alias("stage_no"))


def merge_stages(*stages: DataFrame) -> DataFrame:
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def staged_extract(
    docs: DataFrame,
    fields: Sequence[str],
    layout_stage: Callable[[DataFrame], DataFrame] | None = None,
    enough: float = 0.7,
) -> DataFrame:
    """Stages with early stop. Later stages see only documents the earlier ones left open.

    Labels suffice when at least ``enough`` of the fields exceed 0.8; anchors when every field has a
    value. ``layout_stage`` maps the remaining doc_ids to results (field_name, value, confidence).
    A later result replaces an earlier one only with a higher confidence.
    """
    chosen = choose_stage(header_results(docs, fields))
    if layout_stage is None:
        return chosen
    state = chosen.groupBy("doc_id").agg(
        F.count_if((F.col("stage_no") == 1) & (F.col("confidence") > 0.8)).alias("sure"), F.count("*").alias("found"))
    open_docs = docs.select("doc_id").join(state, "doc_id", "left").where(
        (F.coalesce("sure", F.lit(0)) < len(fields) * enough) & (F.coalesce("found", F.lit(0)) < len(fields))).select("doc_id")
    third = layout_stage(open_docs).where(F.col("field_name").isin(list(fields))).withColumns(
        {"stage_no": F.lit(3), "stage": F.lit("ml"), "confidence": F.col("confidence").cast(SCORE)})
    best = F.struct("confidence", -F.col("stage_no"))
    return merge_stages(chosen, third.select(*chosen.columns)).groupBy("doc_id", "field_name").agg(
        F.max_by(F.struct("stage_no", "stage", "value", "confidence"), best).alias("b")).select("doc_id", "field_name", "b.*")


def field_statistics(chosen: DataFrame, docs: DataFrame, fields: Sequence[str] = HEADER_FIELDS) -> DataFrame:
    """Per field: found, success rate over all documents, mean confidence, four confidence bins."""
    total = docs.agg(F.count("*").alias("documents"))
    c = F.col("confidence").cast(SCORE)
    found = chosen.groupBy("field_name").agg(
        F.count("*").alias("found"), F.sum(c).cast("double").alias("s"),
        F.count_if(c < 0.25).alias("bin_0"), F.count_if((c >= 0.25) & (c < 0.5)).alias("bin_1"),
        F.count_if((c >= 0.5) & (c < 0.75)).alias("bin_2"), F.count_if(c >= 0.75).alias("bin_3"))
    names = docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_name"))
    counts = names.join(found, "field_name", "left").select(
        "field_name", F.coalesce("found", F.lit(0)).alias("found"),
        F.coalesce(F.try_divide(F.col("s"), F.col("found")), F.lit(0.0)).alias("avg_confidence"),
        *[F.coalesce(f"bin_{i}", F.lit(0)).alias(f"bin_{i}") for i in range(4)])
    return counts.withColumn("documents", total.scalar()).withColumn("success_rate", F.try_divide("found", "documents"))


def stage_distribution(results: DataFrame) -> DataFrame:
    return final_stage(results).groupBy("stage_no").agg(F.count("*").alias("documents"))


def classification_summary(classified: DataFrame) -> DataFrame:
    """Batch summary: documents and confidence per type."""
    return classified.groupBy("doc_type").agg(
        F.count("*").alias("documents"), F.sum((F.col("type_confidence") * 10).cast("long")).alias("confidence_tenths"),
        F.count_if(F.col("type_confidence") >= 0.8).alias("high_confidence"))
