"""Field corrections: apply, history, statistics and training records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.confidence import adjust_confidence, clamp
from ledgerlens.functions.normalize import SCORE, score
from ledgerlens.schemas import SENTIMENT_RANK
from ledgerlens.skew import bucketed_window, rank_in_key

STAMP = "timestamp_ntz"


def correction_type(original: Column, corrected: Column) -> Column:
    return F.when(original.isNull() & corrected.isNotNull(), "value_added") \
        .when(original.isNotNull() & corrected.isNull(), "value_cleared").otherwise("value_change")


def severity(critical: Column, count: Column) -> Column:
    return F.when(critical > 0, "critical").when(count > 2, "high").when(count > 0, "medium").otherwise("none")


def filter_corrections(
    enriched: DataFrame,
    field_names: Sequence[str] | None = None,
    reasons: Sequence[str] | None = None,
    users: Sequence[int] | None = None,
    document_ids: Sequence[int] | None = None,
    start: str | None = None,
    end: str | None = None,
    has_feedback: bool | None = None,
    only_critical: bool = False,
    min_sentiment: str | None = None,
    is_verified: bool | None = None,
) -> DataFrame:
    """Conjunction of the given filters; ``is_verified`` needs a column of that name, null counts as not verified."""
    if is_verified is not None:
        enriched = enriched.where(F.coalesce("is_verified", F.lit(False)) == is_verified)
    for column, values in (("field_name", field_names), ("correction_reason", reasons), ("user_id", users), ("doc_id", document_ids)):
        if values:
            enriched = enriched.where(F.col(column).isin(list(values)))
    if start:
        enriched = enriched.where(F.col("corrected_at") >= F.lit(start).cast(STAMP))
    if end:
        enriched = enriched.where(F.col("corrected_at") <= F.lit(end).cast(STAMP))
    if has_feedback is not None:
        enriched = enriched.where(F.col("feedback_sentiment").isNotNull() == has_feedback)
    if only_critical:
        enriched = enriched.where("is_critical")
    if min_sentiment:
        good = [s for s, r in SENTIMENT_RANK.items() if r >= SENTIMENT_RANK[min_sentiment]]
        enriched = enriched.where(F.col("feedback_sentiment").isin(good))
    return enriched


def correction_analytics(enriched: DataFrame, group_by: str = "reason") -> DataFrame:
    """group, corrections, average confidence and share of critical ones, by reason, user, field or date."""
    columns = {"reason": "correction_reason", "user": "user_id", "field": "field_name", "date": "corrected_at"}
    if group_by not in columns:
        raise ValueError(f"group by one of {', '.join(columns)}, not {group_by}")
    key = F.col(columns[group_by])
    key = (F.to_date(key) if group_by == "date" else key).cast("string")
    return enriched.groupBy(key.alias("group")).agg(
        F.count("*").alias("corrections"), (F.sum("confidence").cast("double") / F.count("confidence")).alias("avg_confidence"),
        (F.count_if("is_critical") / F.count("*")).alias("critical_rate"))


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """Last correction per field by (time, id)."""
    row = F.struct("correction_id", "user_id", "corrected_at", "corrected_value", "confidence_adjustment", "is_critical")
    return corrections.groupBy("field_id").agg(
        F.max_by(row, F.struct("corrected_at", "correction_id")).alias("c")).select("field_id", "c.*")


def effective_values(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected value (also a cleared one) over the extracted value, confidence adjusted and clamped."""
    last = latest_corrections(corrections).select(
        "field_id", "corrected_value", F.col("confidence_adjustment").alias("adj"), F.lit(True).alias("has"))
    conf = F.col("confidence").cast(SCORE)
    has = F.coalesce("has", F.lit(False))
    return fields.join(last, "field_id", "left").select(
        "field_id", "doc_id", "field_name",
        F.when(has, F.col("corrected_value")).otherwise(F.col("field_value")).alias("value"),
        F.when(has & F.col("adj").isNotNull(), clamp(F.coalesce(conf, score(0.0)) + F.col("adj"))).otherwise(conf).alias("confidence"),
        F.when(has, "corrected").otherwise("extracted").alias("source"))


def composed(steps: Column) -> Column:
    """One clamped addition (shift, low, high) that stands for an ordered array of them: clamp(x + shift) to low..high."""
    inside = lambda value, s: F.least(s["high"], F.greatest(s["low"], value))
    kind = "struct<shift:decimal(20,4),low:decimal(20,4),high:decimal(20,4)>"
    start = F.struct(score(0.0).alias("shift"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high")).cast(kind)
    return F.aggregate(steps, start, lambda a, s: F.struct(
        (a["shift"] + s["shift"]).alias("shift"), inside(a["low"] + s["shift"], s).alias("low"), inside(a["high"] + s["shift"], s).alias("high")).cast(kind))


def apply_batch(fields: DataFrame, requests: DataFrame, block: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply (request_id, doc_id, field_name, corrected_value, confidence_adjustment) requests in the order of their ids.

    Returns the new field table, the correction records, and an error row per request whose field is
    unknown. A later request for a field works on what the earlier ones left: its record has the value before it, and
    confidences are adjusted and clamped one by one. A clamped addition composes to one, so the requests of a field are
    folded by blocks of ids first and a field with very many requests is not gathered in one row.
    """
    target = fields.groupBy("doc_id", "field_name").agg(F.min_by(
        F.struct("field_id", F.col("field_value").alias("first_value")), "field_id").alias("f"))
    hits = requests.join(target, ["doc_id", "field_name"]).select(requests["*"], "f.*")
    part = F.floor(F.col("request_id") / block)
    before = bucketed_window(hits, ["field_id"], ["request_id"], part, previous={"_before": F.struct("corrected_value")})
    original = F.when(F.col("_before").isNull(), F.col("first_value")).otherwise(F.col("_before.corrected_value"))
    records = before.withColumn("original_value", original).withColumn(
        "correction_type", correction_type(F.col("original_value"), F.col("corrected_value"))).drop("_before", "first_value")
    errors = requests.join(target, ["doc_id", "field_name"], "left_anti").select(
        "request_id", "doc_id", "field_name",
        F.concat(F.lit("Field '"), "field_name", F.lit("' not found")).alias("message"))
    step = F.struct(F.col("confidence_adjustment").cast("decimal(20,4)").alias("shift"), F.lit(0).cast("decimal(20,4)").alias("low"), F.lit(1).cast("decimal(20,4)").alias("high"))
    moves = F.coalesce(F.col("confidence_adjustment"), F.lit(0)) != 0
    ordered = lambda value, order: F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("s"))))), lambda x: x["s"])
    blocks = hits.withColumn("part", part).withColumn("step", F.when(moves, step)).groupBy("field_id", "part").agg(
        F.max_by(F.struct("corrected_value"), "request_id").alias("w"), composed(ordered(F.col("step"), "request_id")).alias("step"),
        F.count_if(F.col("step").isNotNull()).alias("moves"))
    final = blocks.groupBy("field_id").agg(
        F.max_by("w", "part").alias("w"), composed(ordered(F.col("step"), "part")).alias("c"), F.sum("moves").alias("moves"))
    confidence = F.col("confidence").cast(SCORE)
    moved = F.least(F.col("c.high"), F.greatest(F.col("c.low"), F.coalesce(confidence, score(0.0)) + F.col("c.shift"))).cast(SCORE)
    updated = fields.join(final, "field_id", "left").select(
        *[c for c in fields.columns if c not in ("field_value", "confidence", "is_edited")],
        F.when(F.col("w").isNotNull(), F.col("w.corrected_value")).otherwise(F.col("field_value")).alias("field_value"),
        F.when(F.col("moves") > 0, moved).otherwise(confidence).alias("confidence"),
        (F.col("is_edited") | F.col("w").isNotNull()).alias("is_edited"))
    return updated, records, errors


def enrich(corrections: DataFrame, fields: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    """Corrections with field, document and user; a missing user is ``unknown``."""
    f = fields.select("field_id", "doc_id", "field_name", "page_number", "confidence")
    d = docs.select("doc_id", F.col("type").alias("document_type"))
    return corrections.join(f, "field_id").join(d, "doc_id").join(users, "user_id", "left").withColumn(
        "email", F.coalesce("email", F.lit("unknown")))


def document_summary(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row per document with fields; rates and the review flag from counts alone."""
    per_field = corrections.groupBy("field_id").agg(
        F.count("*").alias("n"), F.count_if("is_critical").alias("critical"),
        F.count("feedback_sentiment").alias("feedback"), F.min("corrected_at").alias("first_at"),
        F.max("corrected_at").alias("last_at"))
    known = fields.select("doc_id", "field_id")
    # The fields of a document are counted where they lie: after the join they are spread by their ids and nothing combines.
    # The joins hold a row per corrected field or document of a partition and sort neither side.
    per_doc = known.join(per_field.hint("shuffle_hash"), "field_id").groupBy(F.col("doc_id").alias("of_doc")).agg(
        F.count("n").alias("fields"), F.sum("n").alias("n"), F.sum("critical").alias("critical"), F.sum("feedback").alias("feedback"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    counted = known.groupBy("doc_id").agg(F.count("*").alias("total_fields"))
    agg = counted.join(per_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of_doc")), "left").select(
        "doc_id", "total_fields", *[F.coalesce(c, F.lit(0)).alias(name) for c, name in (
            ("fields", "corrected_fields"), ("n", "total_corrections"), ("critical", "critical_count"), ("feedback", "feedback_count"))],
        "first_at", "last_at")
    rate = F.col("corrected_fields") / F.col("total_fields") * 100
    return agg.withColumn("correction_rate", rate).withColumn(
        "requires_review", (F.col("critical_count") > 0) | (F.col("total_corrections") > 5)).withColumn(
        "requires_review_by_rate", F.col("requires_review") | (F.col("correction_rate") > 50))


def document_breakdown(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections per document by reason, type and feedback, long form, one pass over a fixed-size explode."""
    f = fields.select("field_id", "doc_id")
    kind = correction_type(F.col("original_value"), F.col("corrected_value"))
    pairs = F.array(
        F.struct(F.lit("reason").alias("dimension"), F.col("correction_reason").alias("value")),
        F.struct(F.lit("type").alias("dimension"), kind.alias("value")),
        F.struct(F.lit("feedback").alias("dimension"), F.col("feedback_sentiment").alias("value")))
    return corrections.join(f, "field_id").select("doc_id", F.inline(pairs)).where(F.col("value").isNotNull()).groupBy(
        "doc_id", "dimension", "value").agg(F.count("*").alias("corrections"))


def statistics(enriched: DataFrame, since: str) -> DataFrame:
    """Totals of a period. Distinct counts are exact."""
    e = enriched.where(F.col("corrected_at") >= F.lit(since).cast(STAMP))
    n = F.count("*")
    return e.agg(
        n.alias("total_corrections"), F.countDistinct("field_id").alias("corrected_fields"),
        F.countDistinct("doc_id").alias("documents"), F.countDistinct("email").alias("users"),
        F.count("feedback_sentiment").alias("with_feedback"),
    ).withColumn("avg_per_document", F.col("total_corrections") / F.greatest(F.lit(1), F.col("documents"))).withColumn(
        "feedback_coverage", F.col("with_feedback") / F.greatest(F.lit(1), F.col("total_corrections")))


def statistics_by(enriched: DataFrame, since: str) -> DataFrame:
    """Counts by reason, type, user and feedback in one grouping-sets pass."""
    e = enriched.where(F.col("corrected_at") >= F.lit(since).cast(STAMP)).select(
        F.col("correction_reason").alias("reason"),
        correction_type(F.col("original_value"), F.col("corrected_value")).alias("kind"),
        "email", F.coalesce("feedback_sentiment", F.lit("none")).alias("feedback"))
    dims = ["reason", "kind", "email", "feedback"]
    g = e.groupingSets([[d] for d in dims], *dims).agg(F.count("*").alias("corrections"), F.grouping_id().alias("g"))
    return g.select(
        F.when(F.col("g") == 7, "reason").when(F.col("g") == 11, "type").when(F.col("g") == 13, "user")
        .otherwise("feedback").alias("dimension"),
        F.coalesce(*dims).alias("value"), "corrections")


def daily_corrections(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy(F.to_date("corrected_at").alias("day"), "correction_reason").agg(
        F.count("*").alias("corrections"), F.count_if("is_critical").alias("critical"))


def moving_daily(corrections: DataFrame, days: int = 7) -> DataFrame:
    """Corrections in each sliding window of ``days`` days that moves by a day (batch form of the stream)."""
    stamp = F.col("corrected_at").cast("timestamp")
    return corrections.groupBy(F.window(stamp, f"{days} days", "1 day").alias("w")).agg(
        F.count("*").alias("corrections")).select(
        F.to_date("w.start").alias("window_start"), F.to_date("w.end").alias("window_end"), "corrections")


def correction_rate(fields: DataFrame, docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected over all fields by document type and field name."""
    hit = corrections.select("field_id").distinct().withColumn("hit", F.lit(1))
    f = fields.select("field_id", "doc_id", "field_name").join(hit, "field_id", "left").join(
        docs.select("doc_id", "type"), "doc_id")
    return f.groupBy("type", "field_name").agg(
        F.count("*").alias("fields"), F.count("hit").alias("corrected")).withColumn(
        "rate", F.col("corrected") / F.col("fields"))


def analytics(enriched: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rollup over the chosen dimensions: count, mean confidence adjustment, critical rate."""
    adj = F.col("confidence_adjustment").cast(SCORE)
    return enriched.rollup(*by).agg(
        F.count("*").alias("corrections"), (F.sum(adj).cast("double") / F.count(adj)).alias("avg_adjustment"),
        (F.count_if("is_critical") / F.count("*")).alias("critical_rate"), F.grouping_id().alias("level"))


def sessions(corrections: DataFrame, fields: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Correction sessions per user: a pause of ``gap_minutes`` or more starts a new one.

    Day buckets keep a busy user's rows spread over tasks.
    """
    doc = fields.select("field_id", "doc_id")
    c = corrections.where(F.col("user_id").isNotNull()).join(doc, "field_id")
    order, day = ["corrected_at", "correction_id"], F.to_date("corrected_at")
    p = bucketed_window(c, ["user_id"], order, day, previous={"prev_at": F.col("corrected_at")})
    gap = F.unix_micros(F.col("corrected_at").cast("timestamp")) - F.unix_micros(F.col("prev_at").cast("timestamp"))
    starts = F.when(F.col("prev_at").isNull() | (gap >= gap_minutes * 60 * 1000000), 1).otherwise(0)
    return bucketed_window(p.withColumn("starts", starts).drop("prev_at"), ["user_id"], order, day,
                           running={"session_no": F.col("starts")}).drop("starts")


def session_audit(in_sessions: DataFrame) -> DataFrame:
    """Audit row per session: fields, critical, feedback, start, end and minutes."""
    start, end = F.min("corrected_at"), F.max("corrected_at")
    return in_sessions.groupBy("user_id", "session_no").agg(
        F.count("*").alias("total_corrections"), F.countDistinct("field_id").alias("fields_corrected"),
        F.countDistinct("doc_id").alias("documents"), F.count_if("is_critical").alias("critical"),
        F.count("feedback_sentiment").alias("feedback"), start.alias("started_at"), end.alias("completed_at"),
    ).withColumn("duration_minutes", (
        F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    ) / F.lit(60000000.0))


def versions(corrections: DataFrame) -> DataFrame:
    """Corrections with their version number per field."""
    return rank_in_key(corrections, ["field_id"], ["corrected_at", "correction_id"], F.to_date("corrected_at"), "version")


def history_fold(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Correction history per field in one row: current value, counts, last time, severity."""
    agg = corrections.groupBy("field_id").agg(
        F.max_by(F.struct("corrected_value"), F.struct("corrected_at", "correction_id")).alias("last"),
        F.count("*").alias("correction_count"), F.countDistinct("user_id").alias("users"),
        F.count("feedback_sentiment").alias("feedback_collected"), F.count_if("is_critical").alias("critical"),
        F.max("corrected_at").alias("last_correction_at"))
    return fields.select("field_id", "field_name", "field_value").join(agg, "field_id", "left").select(
        "field_id", "field_name", F.col("field_value").alias("original_value"),
        F.when(F.col("last").isNotNull(), F.col("last.corrected_value")).otherwise(F.col("field_value")).alias("current_value"),
        F.coalesce("correction_count", F.lit(0)).alias("correction_count"), F.coalesce("users", F.lit(0)).alias("users"),
        F.coalesce("feedback_collected", F.lit(0)).alias("feedback_collected"), "last_correction_at",
        severity(F.coalesce("critical", F.lit(0)), F.coalesce("correction_count", F.lit(0))).alias("severity"))


def history_by_user(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("field_id", "user_id").agg(F.count("*").alias("corrections"))


def confidence_history(fields: DataFrame, corrections: DataFrame, penalty: float = 0.15) -> DataFrame:
    """Running confidence of each field: every critical correction lowers it by ``penalty``, not below 0.

    Long form, one row per correction: the step number and the score after it.
    """
    flagged = corrections.withColumn("drop", F.col("is_critical").cast("int"))
    steps = bucketed_window(flagged, ["field_id"], ["corrected_at", "correction_id"], F.to_date("corrected_at"),
                            running={"step": F.lit(1), "drops": F.col("drop")})
    f = fields.select("field_id", F.col("confidence").cast(SCORE).alias("base"))
    value = F.greatest(F.lit(0).cast(SCORE), (F.col("base") - F.col("drops") * score(penalty)).cast(SCORE))
    return steps.join(f, "field_id").select("field_id", "correction_id", "step", value.cast(SCORE).alias("confidence"))


def training_records(enriched: DataFrame) -> DataFrame:
    """Correction records for training: real document type, confidence and correctness."""
    return enriched.select(
        "correction_id", "doc_id", "document_type", "page_number", "field_name",
        F.col("original_value").alias("extracted_value"), F.col("confidence").alias("extraction_confidence"),
        "corrected_value", "correction_reason",
        F.col("original_value").eqNullSafe(F.col("corrected_value")).alias("was_correct"), "feedback_sentiment")


def training_summary(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("record_count"), F.countDistinct("doc_id").alias("documents_included"),
        F.countDistinct("correction_reason").alias("reasons_included"),
        F.count("feedback_sentiment").alias("feedback_records"))
