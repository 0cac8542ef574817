"""Streams over job events: states, retries, stuck jobs, routing, corrections."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.functions.confidence import confidence_level, routing_status, rule_named
from ledgerlens.functions.normalize import SCORE, score
from ledgerlens.operators.jobs import frozen_states

END_STATES = ("completed", "error", "cancelled")


def job_states(job_events: DataFrame) -> DataFrame:
    """State per job, update mode: the first terminal state by event time freezes it."""
    return frozen_states(job_events)


RetryRow = Row("job_id", "event_id", "attempt", "outcome", "delay_seconds")


class RetryCounter(StatefulProcessor):
    """Failures per job: each one becomes a retry with its delay or, at the limit, a dead letter.

    Failures are numbered in the order of their micro-batches, inside a batch by time; a key with more than ``CHUNK`` rows in a batch is
    ordered chunk by chunk. The count of a job goes once the watermark is ``ttl_seconds`` past its last failure.
    """

    def __init__(self, max_attempts: int = 3, base: int = 5, top: int = 60, ttl_seconds: int = 7 * 86400):
        self.max_attempts, self.base, self.top, self.ttl_ms = max_attempts, base, top, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n int, due_ms long")

    CHUNK = 10_000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, due, last = None, None, None  # the state is read for jobs with a failure only
        while chunk := list(islice(rows, self.CHUNK)):
            # without a time or id: behind the others
            failed = sorted((r.at_us is None, r.at_us or 0, r.event_id is None, r.event_id or 0) for r in chunk if r.status == "error")
            if failed and n is None:
                n, due = self.failures.get() or (0, None)
            for no_time, at_us, no_id, event_id in failed:
                n += 1
                last = last if no_time else max(last or 0, at_us)
                dead = n >= self.max_attempts
                yield RetryRow(key[0], None if no_id else event_id, n, "dead_letter" if dead else "retry", 0 if dead else min(self.top, self.base * 2 ** (n - 1)))
        if n is not None:
            later = max((last or 0) // 1000 + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1, due or 0)
            if later != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(later)
            self.failures.update((n, later))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.failures.clear()
        return iter(())

    def close(self) -> None:
        pass


#: What each sink of ``retries`` takes.
RETRY_SINKS = {"retries": "outcome = 'retry'", "dead_letters": "outcome = 'dead_letter'"}


def retries(job_events: DataFrame, max_attempts: int = 3, ttl_seconds: int = 7 * 86400, late: str = "1 day") -> DataFrame:
    """Needs the RocksDB state store. ``runner.write_batches(path, RETRY_SINKS)`` writes retries and dead letters to sinks of their own."""
    e = job_events.withWatermark("event_time", late).select("job_id", "event_id", "status", "event_time", F.unix_micros("event_time").alias("at_us"))
    return e.groupBy("job_id").transformWithState(
        RetryCounter(max_attempts, ttl_seconds=ttl_seconds), "job_id long, event_id long, attempt int, outcome string, delay_seconds int", "append",
        "eventtime")


class StuckDetector(StatefulProcessor):
    """A running job without another event within the limit: found by the next event or by an event-time timer."""

    def __init__(self, limit_seconds: int = 300):
        self.limit_ms = limit_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState("running", "event_id long, at_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since = self.running.get() if self.running.exists() else None
        found = []
        for chunk in rows:
            pdf = chunk.sort_values(["event_time", "event_id"])
            for event_id, status, at in zip(pdf.event_id.tolist(), pdf.status.tolist(), pdf.at_us.tolist()):
                if since is not None and at - since[1] > self.limit_ms * 1000:
                    found.append(since[0])
                since = (event_id, at) if status == "running" else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if since is None:
            self.running.clear()
        else:
            self.running.update(since)
            due = since[1] // 1000 + self.limit_ms + 1
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        if found:
            yield pd.DataFrame({"job_id": key[0], "event_id": found})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.running.exists():
            event_id = self.running.get()[0]
            self.running.clear()
            yield pd.DataFrame({"job_id": [key[0]], "event_id": [event_id]})

    def close(self) -> None:
        pass


def stuck_jobs(job_events: DataFrame, limit_seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """Needs the RocksDB state store."""
    e = job_events.withWatermark("event_time", late).withColumn("at_us", F.unix_micros("event_time"))
    return e.groupBy("job_id").transformWithStateInPandas(
        StuckDetector(limit_seconds), "job_id long, event_id long", "append", "eventtime")


# Corrections

def correction_events(events: DataFrame) -> DataFrame:
    """Corrections as they arrive: user, time, reason, severity."""
    t = F.col("event_type")
    return events.select(
        F.col("event_id").alias("correction_id"), "user_id", F.col("ts").alias("corrected_at"),
        F.when(t == "click", "ocr_error").when(t == "view", "extraction_error").when(t == "purchase", "format_error")
        .when(t == "signup", "missing").otherwise("other").alias("correction_reason"), (F.col("value") > 200).alias("is_critical"))


def daily_corrections(corrections: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per day and reason; rows later than ``late`` are dropped."""
    return corrections.withWatermark("corrected_at", late).groupBy(F.window("corrected_at", "1 day").alias("w"), "correction_reason").agg(
        F.count("*").alias("corrections"), F.count_if("is_critical").alias("critical")).select(
        F.to_date("w.start").alias("day"), "correction_reason", "corrections", "critical")


def moving_corrections(corrections: DataFrame, late: str = "1 hour") -> DataFrame:
    """Seven-day windows that slide by a day."""
    return corrections.withWatermark("corrected_at", late).groupBy(F.window("corrected_at", "7 days", "1 day").alias("w")).agg(
        F.count("*").alias("corrections")).select(F.to_date("w.start").alias("window_start"), "corrections")


def correction_sessions(corrections: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user, emitted once the watermark has passed their end."""
    return corrections.where(F.col("user_id").isNotNull()).withWatermark("corrected_at", late).groupBy(
        F.session_window("corrected_at", gap).alias("s"), "user_id").agg(
        F.count("*").alias("corrections"), F.min("corrected_at").alias("started_at"), F.max("corrected_at").alias("completed_at")).select(
        "user_id", "corrections", "started_at", "completed_at")


# Routing

def route_nested(docs: DataFrame, rule_name: str = "default") -> DataFrame:
    """Routing of self-contained rows (doc_id, confidence, fields: array of field_name and confidence), without state."""
    rule = rule_named(rule_name)
    conf = F.transform("fields", lambda f: F.coalesce(f["confidence"].cast(SCORE), score(0.0)))
    known = F.size(F.filter("fields", lambda f: f["confidence"].isNotNull()))
    total = F.aggregate("__c", F.lit(0).cast("decimal(20,4)"), lambda a, x: (a + x).cast("decimal(20,4)"))
    d = docs.withColumns({"__c": conf, "__n": known}).withColumn(
        "header_avg", F.when(F.col("__n") > 0, total.cast("double") / F.col("__n")).otherwise(F.lit(0.0)))
    return _routed(d, rule).select(
        "doc_id", "header_avg", "header_status", "routing_status", "level", F.size(F.filter("__c", lambda c: c < rule.medium)).alias("low_fields"))


def route_grouped(docs: DataFrame, fields: DataFrame, rule_name: str = "default", within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Routing of documents (doc_id, at, confidence) with fields that come on their own (doc_id, field_at, confidence) up to ``within`` later.

    The same result as ``route_nested``. On streams it is a left outer stream-stream join and an aggregate per document: a document comes out once
    the watermark has passed the time in which fields may come, also if it has none. On tables it is a plain join.
    """
    rule = rule_named(rule_name)
    f = fields.select(F.col("doc_id").alias("f_doc_id"), "field_at", F.col("confidence").alias("f_confidence"), F.lit(True).alias("there"))
    if docs.isStreaming:
        docs, f = docs.withWatermark("at", late), f.withWatermark("field_at", late)
    joined = docs.join(f, F.expr(f"doc_id = f_doc_id and field_at >= at and field_at <= at + interval {within}"), "left_outer")
    c = F.when(F.col("there"), F.coalesce(F.col("f_confidence").cast(SCORE), score(0.0)))
    d = joined.groupBy("at", "doc_id", "confidence").agg(
        F.sum(c).cast("double").alias("total"), F.count("f_confidence").alias("known"), F.count_if(c < rule.medium).alias("low_fields"))
    d = d.withColumn("header_avg", F.when(F.col("known") > 0, F.col("total") / F.col("known")).otherwise(F.lit(0.0)))
    return _routed(d, rule).select("doc_id", "header_avg", "header_status", "routing_status", "level", F.col("low_fields").cast("int").alias("low_fields"))


def _routed(d: DataFrame, rule) -> DataFrame:
    """Adds header_status, routing_status and level to documents with header_avg and their own confidence."""
    own: Column = F.col("confidence")
    d = d.withColumn("header_status", routing_status(F.col("header_avg"), rule))
    approved_only = F.lit(rule.require_all) & (F.col("header_status") != "approved")
    status = F.when(F.col("header_status") == "rejected", "rejected").when(approved_only, "review_required").otherwise(routing_status(own, rule))
    return d.withColumns({"routing_status": status, "level": confidence_level(own, rule)})
