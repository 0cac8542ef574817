"""Streams over several micro-batches, restarts and repeated batches against their batch forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import audit as AU
from ledgerlens.operators import jobs as J
from ledgerlens.session import scratch_path
from ledgerlens.streaming import changes as CH
from ledgerlens.streaming import jobs as SJ
from ledgerlens.streaming import tracker as TR
from ledgerlens.streaming.runner import last_per_key, rocksdb_state, run_available, write_batches

STEP = "job_id long, event_id long, event_time timestamp, step string, status string"
START = datetime(2024, 3, 1)


def reports(seed, jobs=25, n=260):
    rnd = random.Random(seed)
    return [(rnd.randrange(jobs), i, START + timedelta(minutes=rnd.randrange(3000)), rnd.choice([*J.STEPS, "other"]),
             rnd.choices(["done", "failed", "cancelled", "running"], [20, 2, 1, 1])[0]) for i in range(n)]


class Arrivals:
    """A folder that gets one file per micro-batch."""

    def __init__(self, spark, schema, name):
        self.spark, self.schema, self.path = spark, schema, scratch_path(spark, name)
        self.rows = []
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        self.rows += rows
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", "1").parquet(self.path)

    def table(self):
        return self.spark.createDataFrame(self.rows, self.schema)


def plain_steps(rows):
    """Where each job stands, in plain Python."""
    out = {}
    for job in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == job], key=lambda r: (r[2], r[1]))
        ends = [r for r in mine if r[4] in J.ENDINGS]
        before = [r for r in mine if not ends or (r[2], r[1]) < (ends[0][2], ends[0][1])]
        done = {s for _, _, _, s, status in before if status == "done" and s in J.STEPS}
        ahead = next((i for i, s in enumerate(J.STEPS) if s not in done), len(J.STEPS))
        status = "completed" if ahead == len(J.STEPS) else J.ENDINGS[ends[0][4]] if ends else "pending"
        used = len(done) + (status not in ("completed", "pending"))
        out[job] = (J.STEPS[min(ahead, len(J.STEPS) - 1)], status, len(mine) - used)
    return out


def test_job_steps(spark):
    rows = reports(1)
    got = {r.job_id: (r.step, r.status, r.refused) for r in J.job_steps(spark.createDataFrame(rows, STEP)).collect()}
    assert got == plain_steps(rows)
    assert J.job_steps(spark.createDataFrame([], STEP)).count() == 0


def test_tracker_over_shuffled_batches(spark):
    """After each of five micro-batches states and backlog are those of all reports so far; the state goes once jobs have ended."""
    rows = [r for r in reports(2) if r[4] != "running" and r[3] != "other"]
    random.Random(3).shuffle(rows)
    source, path, sums = Arrivals(spark, STEP, "steps"), scratch_path(spark, "tracked"), scratch_path(spark, "sums")
    with rocksdb_state(spark):
        tracked = TR.job_steps(source.stream(), late="30 days", keep_seconds=60)
        for k in range(5):
            source.add(rows[k::5])
            run_available(tracked, path, write_batches(path))
            states = last_per_key(spark.read.parquet(f"{path}/out"), ["job_id"])
            want = plain_steps(source.rows)
            assert {r.job_id: (r.step, r.status, r.refused) for r in states.collect()} == want
            changes = TR.backlog_changes(spark.readStream.schema(tracked.schema).parquet(f"{path}/out/batch_id=*"))
            run_available(TR.live_backlog(changes), sums, write_batches(sums), "update")
            backlog = last_per_key(spark.read.parquet(f"{sums}/out"), ["step", "status"]).where("jobs <> 0")
            counts = {}
            for step, status, _ in want.values():
                counts[step, status] = counts.get((step, status), 0) + 1
            assert {(r.step, r.status): r.jobs for r in backlog.collect()} == counts
        # A marker far ahead: ended jobs lose their reports, a report behind the end is refused, then the mark goes, too.
        late = [(-1, 10**6, START + timedelta(days=400), "ocr", "done")]
        for rows_ in (late, [(-1, 10**6 + 1, START + timedelta(days=500), "ocr", "done")]):
            source.add(rows_)
            run_available(tracked, path, write_batches(path))
    state = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "job").load()
    open_jobs = {j for j, (_, status, _) in plain_steps(rows).items() if status == "pending"}
    assert {r.key.job_id for r in state.select("key").collect()} == open_jobs


EVENT = "job_id long, event_id long, event_time timestamp, status string"


def test_retries_have_two_sinks_and_replay(spark):
    """Attempts go on over micro-batches and a restart; a repeated batch changes neither sink."""
    rnd = random.Random(5)
    rows = [(rnd.randrange(6), i, START + timedelta(minutes=i), rnd.choice(["error", "running", "completed"])) for i in range(120)]
    source, path = Arrivals(spark, EVENT, "failures"), scratch_path(spark, "sinks")
    kept = {}
    inner = write_batches(path, SJ.RETRY_SINKS)

    def write(batch, batch_id):
        kept[batch_id] = [tuple(r) for r in batch.collect()]
        inner(batch, batch_id)

    with rocksdb_state(spark):
        failures = SJ.retries(source.stream())
        for k in range(0, 120, 24):
            source.add(rows[k : k + 24])
            if k % 48:
                run_available(failures, path, write)
        run_available(failures, path, write)
    want = {tuple(r) for r in J.retries(J.job_timeline(source.table())).select("job_id", "event_id", "attempt", "outcome").collect()}

    def sinks():
        return [sorted(tuple(r)[:4] for r in spark.read.parquet(f"{path}/{s}").select("job_id", "event_id", "attempt", "outcome").collect()) for s in SJ.RETRY_SINKS]

    first = sinks()
    assert {r for s in first for r in s} == want and all(first) and all(r[3] == "dead_letter" for r in first[1])
    assert len(kept) >= 5
    for batch_id, found in kept.items():
        inner(spark.createDataFrame(found, failures.schema), batch_id)
    assert sinks() == first


def test_retry_count_is_forgotten(spark):
    source, path = Arrivals(spark, EVENT, "old-failures"), scratch_path(spark, "old")
    with rocksdb_state(spark):
        failures = SJ.retries(source.stream(), ttl_seconds=3600, late="1 minute")
        for day, job in ((0, 1), (0, 1), (5, 2), (9, 3)):
            source.add([(job, len(source.rows), START + timedelta(days=day, minutes=len(source.rows)), "error")])
            run_available(failures, path, write_batches(path, SJ.RETRY_SINKS))
    state = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "failures").load()
    assert {r.key.job_id for r in state.select("key").collect()} == {3}


def test_late_copies_of_payloads_are_left_out(spark):
    """Copies in the same batch, in a later one, hours apart and behind a restart give one result."""
    path = scratch_path(spark, "once")
    write = CH.ingest_once(path)

    def payload(request, value):
        return f'{{"status": true, "request_id": {request}, "result": [{{"data": {{"Total": {{"page": 1, "value": "{value}"}}}}}}]}}'

    def batch(rows):
        return spark.createDataFrame([(p, START + timedelta(hours=h)) for p, h in rows], "payload string, received_at timestamp")

    batches = [
        [(payload(1, "b"), 1), (payload(1, "a"), 0), (payload(2, "x"), 0), ("no json", 0)],
        [(payload(2, "y"), 2), (payload(3, "z"), 2), (payload(3, "z"), 2)],
        [(payload(1, "c"), 9), (payload(3, "q"), 30)], []]

    def results():
        return sorted((r.request_id, r.field_value) for r in spark.read.parquet(f"{path}/results").collect())

    for i, rows in enumerate(batches):
        write(batch(rows), i)
    want = results()
    assert [v for _, v in want] == ["a", "x", "z"]
    write(batch(batches[1]), 1)
    write(batch(batches[0]), 0)
    assert results() == want


VERSION = "entity_id long, event_id long, event_time timestamp, value string"


def test_changes_over_batches(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(7), i, START + timedelta(hours=i), rnd.choice(["a", "b", None])) for i in range(150)]
    source, path = Arrivals(spark, VERSION, "versions"), scratch_path(spark, "changes")
    with rocksdb_state(spark):
        changes = CH.version_changes(source.stream())
        for k in range(0, 150, 30):
            source.add(rows[k : k + 30])
            run_available(changes, path, write_batches(path))
    columns = ["entity_id", "event_id", "action", "before", "after"]
    got = sorted((tuple(r) for r in spark.read.parquet(f"{path}/out").select(columns).collect()), key=repr)
    assert got == sorted((tuple(r) for r in AU.version_changes(source.table()).select(columns).collect()), key=repr)
    assert {r[2] for r in got} == {"insert", "update", "delete"}


def test_snapshot_changes(spark):
    kind = "k long, a string, b int"
    before = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, None, 3), (None, "n", 1), (5, "gone", 0)], kind)
    after = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, "z", 3), (None, "n", 2), (6, "new", None)], kind)
    got = {r.k: (r.action, r.meta) for r in AU.snapshot_changes(before, after, ["k"], ["a", "b"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {2: "update", 3: "update", None: "update", 5: "delete", 6: "insert"}
    assert got[2][1] == '{"before":{"b":null},"after":{"b":"2"}}' and got[None][1] == '{"before":{"b":"1"},"after":{"b":"2"}}'
    assert AU.snapshot_changes(before, before, ["k"], ["a", "b"]).count() == 0


DOC, FIELD = "doc_id long, at timestamp, confidence decimal(5,4)", "doc_id long, field_at timestamp, confidence decimal(5,4)"


@pytest.mark.parametrize("rule", ["strict", "default"])
def test_grouped_routing_equals_nested(spark, rule):
    """Fields outside the time bounds do not count; documents without fields are routed, too."""
    docs = spark.sql(f"select id as doc_id, timestamp'2024-03-01' as at, cast(id * 0.02 as decimal(5,4)) as confidence from range(50)")
    fields = docs.where("doc_id % 4 <> 0").select("doc_id", F.expr("at + interval 5 minutes").alias("field_at"), "confidence").union(
        docs.where("doc_id % 3 = 0").select("doc_id", F.expr("at + interval 1 hour"), F.lit(None).cast("decimal(5,4)")))
    late = docs.select("doc_id", F.expr("at + interval 61 minutes"), F.lit(0).cast("decimal(5,4)"))
    nested = docs.join(fields.groupBy("doc_id").agg(F.collect_list(F.struct("confidence")).alias("fields")), "doc_id", "left")
    nested = nested.withColumn("fields", F.coalesce("fields", F.array().cast("array<struct<confidence:decimal(5,4)>>")))
    got = SJ.route_grouped(docs, fields.union(late), rule)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, SJ.route_nested(nested, rule).collect()))
