"""Prefix rules, pair counts, zones as a table, columns from the data and the staged job against plain Python."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from ledgerlens.operators import layout as L
from ledgerlens.operators import matching as M
from ledgerlens.operators import validation as V
from ledgerlens.operators.extraction import lines_of
from ledgerlens.plans import staged_job as SG
from ledgerlens.sources import export as X

DOCS, FIELDS = "doc_id long, name string, type string, created_at timestamp", "doc_id long, field_id long, field_name string, field_value string"


def rule_data(spark, seed=4, n=70):
    rnd = random.Random(seed)
    docs = [(i, f"D{i}", "invoice" if i % 4 else "other", datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(30))) for i in range(n)]
    values = {i: (rnd.choice(["", "ab", "abc", "ABd", "b" * 300, "b" * 299 + "c", "7", " 7.0 ", "1,000"]), rnd.choice([None, "", "a", "ab", "b" * 299, "7", "900", "x"])) for i in range(n)}
    fields = [(i, 2 * i + k, name, v[k]) for i, v in values.items() for k, name in enumerate(("one", "two"))]
    return docs, values, spark.createDataFrame(docs, DOCS), spark.createDataFrame(fields, FIELDS)


def earlier_pairs(docs, types=None):
    docs = [d for d in docs if types is None or d[2] in types]
    return [(a[0], b[0]) for a in docs for b in docs if (a[3], a[0]) < (b[3], b[0])]


def low(v):
    return (v or "").strip().lower()


def test_prefix_rule(spark):
    docs, values, d, f = rule_data(spark)
    rule = M.MatchRule(1, [("one", "starts_with", "two")], ["invoice"])
    got = M.rule_pairs(d, f, rule)
    want = {(a, b) for a, b in earlier_pairs(docs, {"invoice"}) if low(values[a][0]) and low(values[a][0]).startswith(low(values[b][1]))}
    assert {(r.left_id, r.right_id) for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError, match="equals or starts_with"):
        M.rule_pairs(d, f, M.MatchRule(2, [("one", "contains", "two")]))


def number(v):
    try:
        return float(low(v).replace(",", ""))
    except ValueError:
        return None


@pytest.mark.parametrize("op", ["greater_than", "less_than"])
@pytest.mark.parametrize("n", [0, 1, 70])
def test_pairs_of_an_inequality_are_counted(spark, op, n):
    """With a hot value and ties in time."""
    docs, values, d, f = rule_data(spark, 6, n)
    want = 0
    for a, b in earlier_pairs(docs):
        x, y = number(values[a][0]), number(values[b][1])
        want += x is not None and y is not None and (x > y if op == "greater_than" else x < y)
    assert M.inequality_pairs(d, f, M.MatchRule(1, [("one", op, "two")])).first()[0] == want
    assert n < 70 or want > 20


PLACED = "doc_id long, field_id long, field_name string, field_value string, confidence double, page_number int, x double, y double, width double, height double"


def test_zones_of_any_number_and_size(spark):
    rnd = random.Random(12)
    fields = [(d, 100 * d + k, rnd.choice(["a", "b", "text"]), f"v{d}-{k}", 0.5, rnd.choice([None, 1, 2]), *(rnd.choice([None, *[rnd.uniform(-50, 900) for _ in range(9)]]) for _ in range(2)), 10.0, 4.0)
              for d in range(30) for k in range(rnd.randrange(1, 9))]
    zones = [(t, s, rnd.choice(["a", "b", "c"]), rnd.choice([1, 2, None]), rnd.uniform(-100, 500), rnd.uniform(-100, 500), *(rnd.choice([0.0, 5.0, 90.0, 700.0, 1e7]) for _ in range(2)))
             for t in range(5) for s in range(6)]
    applied = [(d, d % 6) for d in range(28)]
    got = L.zone_upsert(
        spark.createDataFrame(fields, PLACED), spark.createDataFrame(zones, "template_id long, sort_order int, label string, page_number int, x double, y double, width double, height double"),
        spark.createDataFrame(applied, "doc_id long, template_id long"))
    want = {f[1]: (f[0], f[2], f[3], f[6], "kept") for f in fields}
    added = set()
    for doc, template in applied:
        last = {(z[2], z[3] or 1): z for z in sorted(z for z in zones if z[0] == template)}
        mine = sorted((f for f in fields if f[0] == doc), key=lambda f: f[1])
        if not mine and not last:
            continue
        for (label, page), z in last.items():
            inside = [f for f in mine if (f[5] or 1) == page and f[6] is not None and f[7] is not None
                      and z[4] <= f[6] + 5 <= z[4] + z[6] and z[5] <= f[7] + 2 <= z[5] + z[7]]
            value = inside[0][3] if inside else None
            target = [f for f in mine if f[2] == label and (f[5] or 1) == page]
            if target:
                want[target[0][1]] = (doc, label, value, z[4], "updated")
            else:
                added.add((doc, label, page, value, z[4]))
    rows = got.collect()
    assert {r.field_id: (r.doc_id, r.field_name, r.field_value, r.x, r.change) for r in rows if r.change != "added"} == want
    assert {(r.doc_id, r.field_name, r.page_number, r.field_value, r.x) for r in rows if r.change == "added"} == added and added
    assert {r.change for r in rows} == {"kept", "updated", "added"}


def test_columns_from_the_data(spark):
    rows = [(1, 1, "b", "x"), (1, 2, "a", "y"), (1, 3, "b", "later"), (2, 4, "unseen before", "z"), (3, 5, None, "no name")]
    wide = X.wide_of_keys(spark.createDataFrame(rows, FIELDS))
    assert wide.columns == ["doc_id", "a", "b", "unseen before"]
    assert sorted(map(tuple, wide.collect())) == [(1, "y", "later", None), (2, None, None, "z"), (3, None, None, None)]
    with pytest.raises(ValueError, match="more than 2"):
        X.wide_of_keys(spark.createDataFrame(rows, FIELDS), most=2)


def test_later_stages_see_open_documents_only(spark):
    good = "Invoice Number: INV-1\nDate: 01/02/2024\nVendor: Acme\nSubtotal: 10.00\nVAT: 1.00\nTotal: 11.00"
    texts = {1: ("invoice", good), 2: ("receipt", "Total: 5.00"), 3: ("memo", "Total due:\n7.00"), 4: ("memo", ""), 5: ("invoice", None)}
    docs = lines_of(spark.createDataFrame([(i, k, t) for i, (k, t) in texts.items()], "doc_id long, type string, text string"))
    definitions = spark.createDataFrame([("memo", '["total_amount"]', True), ("receipt", '["vat"]', False)], "name string, fields_schema string, active boolean")
    seen = spark.sparkContext.accumulator(0)

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        seen.add(len(batch))
        rows = [(d, f, "m", 0.9) for d, fs in zip(batch.doc_id, batch.fields) for f in [*fs, "not wanted"]]
        return pd.DataFrame(rows, columns=["doc_id", "field_name", "value", "confidence"])

    staged = SG.extract(SG.prepared(docs, definitions), [SG.label_stage(), SG.anchor_stage(), SG.model_stage(model)])
    fields = {(r.doc_id, r.field_name): (r.value, r.stage_no) for r in staged.fields.collect()}
    assert {r.doc_id: r.last_stage for r in staged.documents.collect()} == {1: 1, 2: 3, 3: 2, 4: 3, 5: 3}
    assert seen.value == 3
    assert {r.stage_no: (r.opened, r.closed) for r in staged.stages.collect()} == {1: (5, 1), 2: (4, 1), 3: (3, 3)}
    assert fields[1, "invoice_number"] == ("INV-1", 1) and fields[3, "total_amount"][1] == 2 and fields[2, "payment_method"] == ("m", 3)
    assert fields[2, "total_amount"][1] == 1 and not any(f == "not wanted" for _, f in fields)
    rules = {"*": [V.FieldRule("total_amount", "required")], "receipt": [V.FieldRule("payment_method", "min_length", 3)]}
    report = {r.doc_id: r for r in SG.reported(staged, rules, "2024-06-30").collect()}
    assert set(report) == set(texts) and report[2].broken_rules == 1 and report[2].status == "needs_review" and report[1].broken_rules == 0
