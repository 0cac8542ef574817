"""Documents of the staged job are moved once a stage, tables of pages come from one pass."""

from pyspark.sql import functions as F

from ledgerlens.operators import layout as L
from ledgerlens.operators.extraction import lines_of
from ledgerlens.plans import staged_job as SG
from ledgerlens.plans.fixtures import Tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


DEFINITIONS = "name string, fields_schema string, active boolean"


def test_prepared_documents_are_not_joined(spark):
    """Wanted fields come from one value beside the documents; an id with several texts or definitions has a row for each of both."""
    docs = lines_of(spark.createDataFrame([(1, "memo", "a"), (1, "memo", "b"), (2, "receipt", "c"), (3, None, "d"), (None, "memo", "e")], "doc_id long, type string, text string"))
    definitions = spark.createDataFrame([("memo", '["vat"]', True), ("memo", "broken", True), ("receipt", '["vat"]', False), (None, '["vat"]', True)], DEFINITIONS)
    out = SG.prepared(docs, definitions)
    assert "Join" not in plan_of(out) and plan_of(out).count("Exchange hashpartitioning(doc_id") == 1
    got = sorted((r.doc_id, r.text, len(r.fields)) for r in out.collect())
    invoice, receipt = 7, 5
    assert got == sorted([(1, t, n) for t in "ab" for n in (1, invoice) * 2] + [(2, "c", receipt), (3, "d", invoice)])
    assert SG.prepared(docs, definitions.where("false")).count() == 2 * 2 + 2


def test_invoice_documents_lie_by_document(spark):
    """The join by document comes last, so rows by document are not shuffled again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = Tables(spark, "/root/testdata/sf0.001").invoice_docs
        assert plan_of(docs.groupBy("doc_id").count()).count("Exchange hashpartitioning") == plan_of(docs).count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stages_keep_the_best_result_of_each_wanted_field(spark):
    """An id that comes twice is closed by either copy; a later result wins with a higher confidence only."""
    docs = spark.createDataFrame([(1, "memo", "x", ["x"], ["a", "b"]), (1, "note", "y", ["y"], ["a"]), (2, "memo", "z", ["z"], ["a", "b"])],
                                 "doc_id long, type string, text string, lines array<string>, fields array<string>")
    result = "doc_id long, field_name string, value string, confidence double"
    first = SG.Stage(1, lambda d: spark.createDataFrame([(1, "a", "one", 0.9), (2, "a", "low", 0.6), (2, "a", "high", 0.7), (2, "b", "weak", 0.4), (2, "c", "unasked", 0.9)], result), lambda n, found, sure: sure >= n, 0.5)
    seen = []

    def later(d):
        seen.append(sorted(r.doc_id for r in d.collect()))
        return spark.createDataFrame([(1, "b", "closed", 0.9), (2, "a", "equal", 0.7), (2, "b", "late", 0.8), (None, "a", "none", 0.9)], result)

    staged = SG.extract(docs, [first, SG.Stage(2, later, lambda n, found, sure: found >= n, 0.5)])
    assert seen == [[2]]
    assert sorted((r.doc_id, r.field_name, r.value, r.stage_no) for r in staged.fields.collect()) == [(1, "a", "one", 1), (2, "a", "high", 1), (2, "b", "late", 2)]
    assert sorted((r.doc_id, r.type, r.last_stage) for r in staged.documents.collect()) == [(1, "memo", 1), (1, "note", 1), (2, "memo", 2)]
    assert sorted(map(tuple, staged.stages.collect())) == [(1, 3, 2), (2, 1, 1)]


def test_windows_over_the_boxes_run_once_for_columns_tables_and_cells(spark, monkeypatch):
    """Repeated header boxes are columns of their own; rates come from what was written, not from the boxes again."""
    runs = []
    monkeypatch.setattr(L, "table_parts", lambda rowed, keys, make=L.table_parts: runs.append(1) or make(rowed, keys))
    rows = [(p, 10 * line + col, text, 80.0 * col, 80.0 * col + 60, 30.0 * line, 30.0 * line + 20) for p in (1, 2) for line in range(3)
            for col, text in enumerate(["Item", "Qty"] if not line else [f"Part {line}", str(line)])]
    found = L.page_tables(spark.createDataFrame([*rows, rows[0], (None, 1, "Item", 0.0, 1.0, 0.0, 1.0)], "page_id long, box_id long, text string, x_min double, x_max double, y_min double, y_max double"))
    assert [plan_of(f).count("Window") for f in (found.columns, found.tables, found.cells, L.column_detection(found))] == [0] * 4 and runs == [1]
    assert sorted((r.page_id, r.col_idx, r.detected_name, r.standard_name, r.name_confidence, r.c_min, r.c_max) for r in found.columns.collect()) == [
        (1, 0, "Item", "item_name", 0.95, 0.0, 0.0), (1, 1, "Item", "item_name", 0.95, 0.0, 80.0), (1, 2, "Qty", "quantity", 0.95, 80.0, 140.0),
        (2, 0, "Item", "item_name", 0.95, 0.0, 80.0), (2, 1, "Qty", "quantity", 0.95, 80.0, 140.0)]
    assert sorted((r.page_id, r["columns"], r["rows"], r["cells"], r.header_row, r.rx_max) for r in found.tables.collect()) == [(1, 3, 2, 4, 0, 140.0), (2, 2, 2, 4, 0, 140.0)]
    rates = {r.standard_name: (r.possible, r.extracted) for r in L.column_detection(found).collect()}
    assert rates == {"item_name": (6, 4), "quantity": (4, 4)}


def test_numbers_of_cells_are_searched_once(spark):
    rows = [("amount", "1,5 kg"), ("amount", "x"), ("amount", None), ("item_name", "7"), ("item_name", None), (None, "5"), (None, "x"), ("quantity", " .5 ")]
    out = L.with_check(spark.createDataFrame(rows, "standard_name string, value string").repartition(2), F.col("value"), F.col("standard_name"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1
    got = {(r.standard_name, r.value): (r.is_valid, r.number and float(r.number), r.confidence) for r in out.collect()}
    assert got == {
        ("amount", "1,5 kg"): (True, 1.5, 0.95), ("amount", "x"): (False, None, 0.1), ("amount", None): (False, None, 0.1), ("item_name", "7"): (True, None, 0.9),
        ("item_name", None): (True, None, 0.9), (None, "5"): (True, None, 0.9), (None, "x"): (None, None, 0.9), ("quantity", " .5 "): (True, 0.5, 0.95)}
