"""History of processing jobs: time in state, attempts, retries, stuck jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.skew import bucketed_window

ORDER = ["event_time", "event_id"]

# The steps of a job in order, and the status that an ending report leaves.
STEPS = ["orchestrate", "render", "ocr", "extract"]
ENDINGS = {"failed": "error", "cancelled": "cancelled"}


def backoff_seconds(attempt: Column, base: int = 5, top: int = 60) -> Column:
    """base * 2^(attempt - 1), at most ``top``."""
    return F.least(F.lit(float(top)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1)).cast("int")


def requeue_seconds(retry_count: Column) -> Column:
    """Delay of the step queue: 10 * 2^retries; null where that is no 64-bit number any more (60 retries)."""
    return F.when(retry_count < 60, F.call_function("shiftleft", F.lit(5).cast("long"), (retry_count + 1).cast("int")))


def job_timeline(job_events: DataFrame) -> DataFrame:
    """Per event: seconds until the job's next event and the number of failures so far. Keys are cut by day."""
    failed = (F.col("status") == "error").cast("int")
    steps = bucketed_window(job_events, ["job_id"], ORDER, F.to_date("event_time"),
                            following={"next_time": F.col("event_time")}, running={"failures": failed})
    micros = F.unix_micros(F.col("next_time").cast("timestamp")) - F.unix_micros(F.col("event_time").cast("timestamp"))
    return steps.withColumn("micros_in_state", micros)


def retries(timeline: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Failure events as retries with their delay, or as dead letters once the attempts are used up."""
    f = timeline.where(F.col("status") == "error")
    dead = F.col("failures") >= max_attempts
    return f.select(
        "job_id", "event_id", F.col("failures").alias("attempt"), F.when(dead, "dead_letter").otherwise("retry").alias("outcome"),
        F.when(~dead, backoff_seconds(F.col("failures"))).alias("delay_seconds"))


def stuck(timeline: DataFrame, limit_seconds: int = 300) -> DataFrame:
    """Running periods longer than the limit (or never ended)."""
    limit = limit_seconds * 1000000
    return timeline.where((F.col("status") == "running") & (F.col("micros_in_state").isNull() | (F.col("micros_in_state") > limit))).select(
        "job_id", "event_id", "event_time")


def frozen_states(job_events: DataFrame) -> DataFrame:
    """State per job when the first terminal state freezes it: that state, else the latest one."""
    place = F.struct(*ORDER)
    end = F.col("status").isin("completed", "error", "cancelled")
    return job_events.groupBy("job_id").agg(
        F.coalesce(F.min_by(F.when(end, F.col("status")), F.when(end, place)), F.max_by("status", place)).alias("status"))


def job_steps(step_events: DataFrame) -> DataFrame:
    """job_id, step, status, refused: where each job stands.

    Per step the first ``done`` report counts, and only before the first ending (``failed``, ``cancelled``); a job is completed once all steps
    are done, else ended, else pending at the first step that is not done. Refused are repeats and what comes after the end.
    One aggregation with map-side combine.
    """
    place = F.struct(*ORDER)
    ending = F.col("status").isin(*ENDINGS)
    first = {s: F.min(F.when((F.col("status") == "done") & (F.col("step") == s), place)) for s in STEPS}
    jobs = step_events.groupBy("job_id").agg(
        F.min(F.when(ending, place)).alias("end"), F.min_by(F.when(ending, F.col("status")), F.when(ending, place)).alias("ending"),
        F.count("*").alias("total"), *[c.alias(s) for s, c in first.items()])
    done = [F.col(s).isNotNull() & (F.col("end").isNull() | (F.col(s) < F.col("end"))) for s in STEPS]
    ahead = F.lit(len(STEPS))
    for i in reversed(range(len(STEPS))):
        ahead = F.when(~done[i], F.lit(i)).otherwise(ahead)
    jobs = jobs.withColumns({"ahead": ahead, "used": sum((d.cast("long") for d in done), F.lit(0).cast("long"))})
    completed = F.col("ahead") == len(STEPS)
    status = F.when(completed, "completed").when(F.col("end").isNull(), "pending")
    for name, state in ENDINGS.items():
        status = status.when(F.col("ending") == name, state)
    step = F.element_at(F.array(*[F.lit(s) for s in STEPS]), F.least(F.col("ahead") + 1, F.lit(len(STEPS))))
    ended_early = (~completed & F.col("end").isNotNull()).cast("long")
    return jobs.select("job_id", step.alias("step"), status.alias("status"), (F.col("total") - F.col("used") - ended_early).alias("refused"))
