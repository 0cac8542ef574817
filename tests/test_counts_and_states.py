"""Pairs of an inequality over many blocks, stateful processors by row, cells of tables by one pass."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerlens.operators import matching as M
from ledgerlens.streaming import jobs as SJ
from ledgerlens.streaming import tracker as TR


@pytest.mark.parametrize("op", ["greater_than", "less_than"])
def test_pairs_of_an_inequality_over_many_blocks(spark, monkeypatch, op):
    """Few values, many of one time: ranges and blocks are cut through both."""
    monkeypatch.setattr(M, "BLOCK", 16)
    rnd = np.random.default_rng(7)
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=int(rnd.integers(5))), *(None if rnd.random() < 0.1 else int(v) for v in rnd.integers(0, 4, 2))) for i in range(150)]
    docs = spark.createDataFrame([(i, f"d{i}", "invoice", at) for i, at, _, _ in rows], "doc_id long, name string, type string, created_at timestamp_ntz")
    fields = spark.createDataFrame(
        [(2 * i + k, i, name, None if v is None else str(v)) for i, _, x, y in rows for k, name, v in ((0, "one", x), (1, "two", y))],
        "field_id long, doc_id long, field_name string, field_value string")
    holds = (lambda a, b: a > b) if op == "greater_than" else (lambda a, b: a < b)
    want = sum(1 for i, s, x, _ in rows for j, t, _, y in rows if (s, i) < (t, j) and x is not None and y is not None and holds(x, y))
    assert M.inequality_pairs(docs, fields, M.MatchRule(1, [("one", op, "two")])).first()[0] == want


def test_lefts_behind():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50):
        place, left = rnd.integers(0, n // 2 + 1, n), rnd.random(n) < 0.5
        assert M.lefts_behind(place, left) == sum(1 for j in range(n) for i in range(j + 1, n) if left[i] and not left[j] and place[i] < place[j])


class Calls:
    """State and handle of one key that count the calls, each of which is a message to the JVM."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_tracker_calls_the_state_twice_for_an_open_job():
    report, calls = Row("step", "status", "at_us", "event_id"), Calls()
    tracker = TR.StepTracker()
    tracker.init(calls)
    assert [tuple(r) for r in tracker.handleInputRows((1,), iter([report("orchestrate", "done", 5, 1), report("ocr", "done", None, 2)]), calls)] == [
        (1, "render", "pending", 0, None, None)]
    assert calls.calls == 2
    assert [tuple(r) for r in tracker.handleInputRows((1,), iter([report("ocr", "failed", 9, 3)]), calls)] == [(1, "render", "error", 0, "render", "pending")]
    assert calls.calls == 5 and len(calls.timers) == 1
    list(tracker.handleInputRows((1,), iter([report("ocr", "failed", 7, 4)]), calls))
    assert len(calls.timers) == 1


def test_retries_read_the_state_of_failed_jobs_only():
    event, calls = Row("status", "at_us", "event_id"), Calls()
    counter = SJ.RetryCounter(max_attempts=3, ttl_seconds=60)
    counter.init(calls)
    assert list(counter.handleInputRows((1,), iter([event("running", 1, 1)]), calls)) == [] and calls.calls == 0
    got = list(counter.handleInputRows((1,), iter([event("error", 9, 3), event("error", None, 4), event("error", 5, 2)]), calls))
    assert [tuple(r) for r in got] == [(1, 2, 1, "retry", 5), (1, 3, 2, "retry", 10), (1, 4, 3, "dead_letter", 0)]
    assert calls.value[0] == 3 and calls.calls == 3 and len(calls.timers) == 1


def test_cells_are_found_without_a_join(spark):
    """The header's columns come by a window over the table: boxes are read and shuffled once."""
    from ledgerlens.operators import layout as L

    rows = [(p, 10 * line + col, text, x, x + 70.0, 30.0 * line, 30.0 * line + 20) for p in (1, 2, None) for line in range(3)
            for col, (x, text) in enumerate([(10.0, "Item" if not line else f"Part {line}"), (90.0, "Qty" if not line else str(line))])]
    boxes = spark.createDataFrame(rows, "page_id long, box_id long, text string, x_min double, x_max double, y_min double, y_max double")
    cells = L.table_cells(boxes)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan") == 1
    got = {(r.page_id, r.row_idx, r.col_idx): (r.standard_name, r.value) for r in cells.collect()}
    assert got == {(p, n, c): (name, f"Part {n}" if not c else str(n)) for p in (1, 2) for n in (1, 2) for c, name in ((0, "item_name"), (1, "quantity"))}
