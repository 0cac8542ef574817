"""How often rows are moved, and what of them."""

import re

from pyspark.sql import functions as F
from test_rules_zones_stages import PLACED

from ledgerlens.operators import corrections as C
from ledgerlens.operators import layout as L
from ledgerlens.plans.fixtures import Tables

ZONES = "template_id long, sort_order int, label string, page_number int, x double, y double, width double, height double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fields_of_templates_are_shuffled_once(spark, tmp_path):
    """With repeated fields and templates, two templates of a document, and keys that are null."""
    fields = [(1, 1, "a", "one", 0.5, None, 0.0, 0.0, 2.0, 2.0), (1, 1, "a", "one", 0.5, None, 0.0, 0.0, 2.0, 2.0), (1, 2, "a", "two", 0.6, 1, 50.0, 50.0, 2.0, 2.0),
              (2, 3, "b", "far", 0.7, 2, 0.0, 0.0, 2.0, 2.0), (3, 4, None, "no name", 0.8, 1, 0.0, 0.0, 2.0, 2.0), (4, 5, "a", "no place", 0.9, 1, None, 0.0, 2.0, 2.0),
              (None, 6, "a", "no document", 0.9, 1, 0.0, 0.0, 2.0, 2.0)]
    zones = [(7, 0, "a", 1, 40.0, 40.0, 20.0, 20.0), (7, 1, "b", None, 0.0, 0.0, 5.0, 5.0), (8, 0, "a", 1, 0.0, 0.0, 900.0, 900.0), (9, 0, None, 1, 0.0, 0.0, 5.0, 5.0), (None, 0, "a", 1, 0.0, 0.0, 5.0, 5.0)]
    applied = [(1, 7), (2, 7), (2, 7), (3, 9), (4, 8), (4, 7), (5, 8), (None, 8), (6, None)]
    spark.createDataFrame(zones, ZONES).coalesce(1).write.parquet(f"{tmp_path}/zones")  # files have a size, so the plan can send few zones to all
    out = L.zone_upsert(spark.createDataFrame(fields, PLACED), spark.read.parquet(f"{tmp_path}/zones"), spark.createDataFrame(applied, "doc_id long, template_id long"))
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", plan_of(out))) == 1
    rows = [(r.doc_id, r.field_id if r.change != "added" else None, r.field_name, r.page_number, r.field_value, r.x, r.change) for r in out.collect()]
    want = [
        (1, 1, "a", None, "two", 40.0, "updated"), (1, 1, "a", None, "two", 40.0, "updated"), (1, 2, "a", 1, "two", 50.0, "kept"), (1, None, "b", 1, "one", 0.0, "added"),
        (2, 3, "b", 2, "far", 0.0, "kept"), *[(2, None, "a", 1, None, 40.0, "added"), (2, None, "b", 1, None, 0.0, "added")] * 2,
        (3, 4, None, 1, "no name", 0.0, "kept"), (3, None, None, 1, None, 0.0, "added"),
        (4, 5, "a", 1, None, 0.0, "updated"), (4, 5, "a", 1, None, 40.0, "updated"), (4, None, "b", 1, None, 0.0, "added"),
        (5, None, "a", 1, None, 0.0, "added"), (None, 6, "a", 1, "no document", 0.0, "kept"), (None, None, "a", 1, None, 0.0, "added")]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_document_summary_sorts_no_fields(spark):
    """With repeated and null keys: a field row counts as often as it is there, null documents are one."""
    fields = [(1, 11), (1, 11), (1, 12), (2, 21), (None, 31), (None, 32), (3, None), (4, 11)]
    corrections = [(11, True, "good", "2024-01-02"), (11, False, None, "2024-01-01"), (31, False, None, "2024-01-05"), (None, True, "poor", "2024-01-03"), (99, True, "poor", "2024-01-03")]
    out = C.document_summary(
        spark.createDataFrame(fields, "doc_id long, field_id long"),
        spark.createDataFrame(corrections, "field_id long, is_critical boolean, feedback_sentiment string, corrected_at string").withColumn("corrected_at", F.to_date("corrected_at")))
    assert "SortMergeJoin" not in plan_of(out) and "Sort [" not in plan_of(out)
    got = {r.doc_id: (r.total_fields, r.corrected_fields, r.total_corrections, r.critical_count, r.feedback_count, r.first_at and str(r.first_at), r.last_at and str(r.last_at), r.requires_review) for r in out.collect()}
    assert got == {
        1: (3, 2, 4, 2, 2, "2024-01-01", "2024-01-02", True), 2: (1, 0, 0, 0, 0, None, None, False), None: (2, 1, 1, 0, 0, "2024-01-05", "2024-01-05", False),
        3: (1, 0, 0, 0, 0, None, None, False), 4: (1, 1, 2, 1, 1, "2024-01-01", "2024-01-02", True)}


def test_fields_compute_what_is_read(spark):
    ids = Tables(spark, "/root/testdata/sf0.001").extracted_fields.select("doc_id", "field_id")
    plan = plan_of(ids)
    assert "l_extendedprice" not in plan and "c_name" not in plan and "l_orderkey" in plan
