"""Steps that were compiled into methods too long for the JVM's compiler, ran inside arrays, or parsed a text many times."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.geometry import quad_to_xywh
from ledgerlens.functions.normalize import parse_date
from ledgerlens.operators import extraction as E
from ledgerlens.plans.catalog import QUERIES
from ledgerlens.sources import ocr

COMPILED = 8000  # bytes of a method that the JVM still compiles


def plan(df):
    return df._jdf.queryExecution().executedPlan()


def largest_method(spark, df):
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan(df)))))


@pytest.mark.parametrize("name", ["validation_report", "validation_statistics", "header_by_label"])
def test_methods_are_short_enough_to_be_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        assert largest_method(spark, QUERIES[name].run(spark, "/root/testdata/sf0.001")) < COMPILED
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", limit)


def test_anchors_are_searched_in_rows(spark):
    docs = spark.createDataFrame([
        (1, ["Invoice", None, "No. A-7", "Total", "", "", "12.50"]), (2, ["total: 5", "SUBTOTAL 7.25"]), (3, [None]), (4, None), (None, ["vat 3.00"])],
        "doc_id long, lines array<string>")
    got = E.anchor_candidates(docs, ["invoice_number", "total_amount", "vat"])
    assert "transform(lines" not in plan(got).toString()
    found = {(r.doc_id, r.field_name, r.line_no, r.anchor_no): (r.value, float(r.confidence)) for r in got.collect()}
    assert found[(1, "total_amount", 3, 0)] == ("12.50", 0.22)  # three lines behind
    assert found[(2, "total_amount", 1, 0)] == ("7.25", 0.8)
    assert found[(None, "vat", 0, 0)] == ("3.00", 0.8)
    assert not [k for k in found if k[0] in (3, 4)]


def test_boxes_of_quads_need_no_array_functions_and_skip_nulls(spark):
    quads = spark.createDataFrame([
        ([[1.0, 2.0], [5.0, 2.5], [4.0, 9.0], [1.5, 8.0]],), ([[1.0, None], [3.0, 4.0], None, [2.0]],), ([[1.0, 2.0]],), (None,)], "q array<array<double>>")
    out = quads.select(quad_to_xywh(F.col("q")).alias("b"))
    assert "transform" not in plan(out).toString()
    assert [r.b and tuple(r.b) for r in out.collect()] == [(1.0, 2.0, 4.0, 7.0), (1.0, 4.0, 2.0, 0.0), None, None]


def test_paged_results_are_parsed_once(spark):
    raw = spark.createDataFrame([
        (1, '[[[], [[[1,2],[3,2],[3,4],[1,4]], ["  a ", 0.75]], [[[0,0]]]], null, [[[[0,0],[2,0]], ["b"]], [[], []], [[[0,0],[1,0],[1,1],[0,1]], ["c", "x"]]]]'),
        (2, "no json"), (3, None)], "doc_id long, results string")
    out = ocr.paged_fields(raw)
    assert plan(out).toString().count("array<array<double>>") + plan(out).toString().count("ArrayType(ArrayType(DoubleType") <= 2
    assert sorted(map(tuple, out.collect())) == [
        (1, "text_0", "a", 0.75, 1, 1.0, 2.0, 2.0, 2.0), (1, "text_1", "b", None, 3, None, None, None, None), (1, "text_2", "c", None, 3, 0.0, 0.0, 1.0, 1.0)]


def test_the_first_real_date_counts(spark):
    texts = spark.createDataFrame([("31/02/2024 2024/03/05",), ("05/03/2567",), ("5-3-24",), ("none",), (None,)], "t string")
    got = [r.d and (str(r.d.value), float(r.d.confidence), r.d.format) for r in texts.select(parse_date("t").alias("d")).collect()]
    assert got[1:] == [("2024-03-05", 0.95, "DD/MM/YYYY"), ("2024-03-05", 0.85, "DD/MM/YY"), None, None]
