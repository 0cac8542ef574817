"""Column builders on small cases with known answers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens import hooks
from ledgerlens.functions import classify as K
from ledgerlens.functions import normalize as N
from ledgerlens.functions import text as X
from ledgerlens.functions.confidence import adjust_confidence, header_score, proximity_score
from ledgerlens.operators import extraction as E
from ledgerlens.operators import validation as V


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [
    ("15/02/2567", dt.date(2024, 2, 15)), ("2024-02-15", dt.date(2024, 2, 15)), ("15/02/24", dt.date(2024, 2, 15)),
    ("๑๕/๐๒/๒๕๖๗", dt.date(2024, 2, 15)), ("15 กุมภาพันธ์ 2567", dt.date(2024, 2, 15)), ("1/1/1995", dt.date(1995, 1, 1)),
    ("29/02/2023", None), ("31/02/2024", None), ("invalid", None), ("", None),
])
def test_dates(spark, text, want):
    got = one(spark, text, N.parse_date)
    assert (got and got["value"]) == want


@pytest.mark.parametrize("text,want", [
    ("5,500.00", "5500.0"), ("5.500,00", "5500.0"), ("$1,000.50", "1000.5"), ("฿ 1,234", "1234.0"), ("12,34", "12.34"),
    ("1.234.567", "1234567.0"), ("๑๒๓", "123.0"), ("1.25", "1.25"), ("abc", None), ("", None),
])
def test_amounts(spark, text, want):
    assert one(spark, text, lambda c: N.amount_text(N.parse_amount(c))) == want


def test_tax_id(spark):
    digits = "110050082222"
    total = sum(int(d) * w for d, w in zip(digits, range(13, 1, -1))) % 11
    good = digits + str((11 - total) % 10)
    bad = digits + str((int(good[-1]) + 1) % 10)
    assert one(spark, good, N.tax_id_problem) is None
    assert one(spark, "1-1005-00822-22-" + good[-1], N.tax_id_problem) is None
    assert one(spark, bad, N.tax_id_problem) == "Tax ID checksum failed"
    assert one(spark, "123", N.tax_id_problem) == "Tax ID must be 13 digits, got 3"
    assert one(spark, "", N.tax_id_problem) == "Tax ID is empty"


def test_check_values(spark):
    rows = [("date", "15/02/2567", True, "0.0500"), ("date", "invalid", False, "0.4000"), ("date", "15/02/2999", False, "0.2000"),
            ("currency", "0", True, "0.3000"), ("currency", "x", False, "0.3000"), ("text", "any", True, "0.0000"), ("integer", "a", False, "0.2000"),
            ("text", "", False, "0.3000")]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _, _) in enumerate(rows)], "i int, kind string, field_value string")
    got = {r["i"]: (r["is_valid"], str(r["adjustment"])) for r in V.check_values(df, "2025-01-01").collect()}
    assert [got[i] for i in range(len(rows))] == [(ok, adj) for _, _, ok, adj in rows]


def test_classifier_examples(spark):
    docs = [
        (1, "INVOICE Invoice Number: INV-2026-001 Subtotal: 1000 Tax: 100 Total: 1100", "invoice"),
        (2, "RECEIPT Thank you Cash Store", "receipt"), (3, "PURCHASE ORDER PO Ship to Delivery date", "purchase_order"), (4, "lorem ipsum", "unknown"),
        (5, "invoices and posture", "unknown"),
    ]
    df = spark.createDataFrame([d[:2] for d in docs], "id int, text string")
    got = {r["id"]: (r["doc_type"], r["type_confidence"]) for r in K.keyword_classify(df, "text").collect()}
    assert {i: got[i][0] for i, _, _ in docs} == {i: t for i, _, t in docs}
    assert got[4][1] == 0.0 and got[1][1] == 1.0


def test_keyword_edges(spark):
    def hit(text, word):
        return one(spark, text, lambda c: c.rlike(K.keyword_regex(word)))

    assert hit("inv. 5", "inv.") and hit("the po is", "po") and not hit("export", "po")
    assert hit("ราคา 5", "ราคา") and not hit("a_po", "po")


def test_custom_keyword_set(spark):
    sets = {"letter": K.KeywordSet(primary=["dear"], negative=["invoice"])}
    df = spark.createDataFrame([("Dear Sir",), ("dear invoice",)], "text string")
    assert [r["doc_type"] for r in K.keyword_classify(df, "text", sets=sets).collect()] == ["letter", "unknown"]


def test_header_lines(spark):
    lines = ["ACME INVOICE", "Invoice Number: inv-7", "Date: 15/02/2567", "Vendor: Acme Ltd.", "Subtotal: 1,000.00", "VAT: 70.00", "Total: 1,070.00", "Tax ID", "", "1234567890123"]
    d = spark.createDataFrame([(1, lines, "\n".join(lines))], "doc_id int, lines array<string>, text string")
    got = {r["field_name"]: (r["value"], float(r["confidence"]), r["stage_no"]) for r in E.chosen_headers(d).collect()}
    assert got["invoice_number"] == ("INV-7", 0.95, 1)
    assert got["invoice_date"][0] == "15/02/2567" and got["vendor_name"][0] == "Acme Ltd."
    assert got["subtotal"][0] == "1000.0" and got["vat"][0] == "70.0" and got["total_amount"][0] == "1070.0"
    anchors = {r["field_name"]: (r["value"], float(r["confidence"])) for r in E.anchor_results(d).collect()}
    assert anchors["tax_id"] == ("1234567890123", 0.35)


def test_scores(spark):
    df = spark.range(1)
    base = F.lit(Decimal("0.95"))
    assert float(df.select(header_score(base, F.lit("x")).alias("r")).first()["r"]) == 0.475
    assert float(df.select(proximity_score(F.lit(9)).alias("r")).first()["r"]) == 0.1
    assert float(df.select(adjust_confidence(F.lit(Decimal("0.9")), F.lit(Decimal("0.5"))).alias("r")).first()["r"]) == 1.0


@pytest.mark.parametrize("text,want", [("o'neil is here", "O'Neil Is Here"), ("ABC-def", "Abc-Def")])
def test_title_case(spark, text, want):
    assert one(spark, text, X.title_case) == want


def test_hooks(spark):
    hooks.register_classifier("first_letter", lambda c: F.substring(c, 1, 1))
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert hooks.classify_with(df, "first_letter", "text").first()["doc_type"] == "a"
    out = hooks.model_stage(df, lambda p: p.assign(field_name="f", value=p.text.str.upper(), confidence=0.7)).first()
    assert (out["value"], out["confidence"]) == ("ABC", 0.7)
    assert df.select(hooks.VALIDATORS["currency"](F.lit("1,5")).alias("r")).first()["r"]


def test_staged_extraction_asks_the_layout_stage_only_for_open_documents(spark):
    from ledgerlens.operators import layout as L

    fields = ["invoice_number", "total_amount", "tax_id"]
    texts = [(1, "Invoice No: A-1\nTotal: 10.00\nTax ID: 99-1"), (2, "Invoice No: B-2\nno more here")]
    docs = E.lines_of(spark.createDataFrame(texts, "doc_id long, text string"))
    boxes = spark.createDataFrame(
        [(d, 1, "Total", 0.0, 0.0, 40.0, 20.0) for d in (1, 2)] + [(d, 2, "77.5", 60.0, 0.0, 100.0, 20.0) for d in (1, 2)],
        "page_id long, box_id long, text string, x_min double, y_min double, x_max double, y_max double")
    asked = []

    def layout_stage(open_docs):
        asked.extend(r["doc_id"] for r in open_docs.collect())
        return L.layout_results(boxes.join(open_docs.withColumnRenamed("doc_id", "page_id"), "page_id", "left_semi"))

    got = {(r["doc_id"], r["field_name"]): (r["value"], r["stage_no"]) for r in E.staged_extract(docs, fields, layout_stage).collect()}
    assert asked == [2]
    assert got[(1, "total_amount")] == ("10.0", 1) and got[(2, "total_amount")] == ("77.5", 3) and got[(2, "invoice_number")] == ("B-2", 1)


def test_document_job_writes_and_reads_back(spark, tmp_path):
    from ledgerlens.plans import document_job
    from ledgerlens.plans.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    document_job.run(t.doc_lines, t.ocr_boxes, "2024-06-30", str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/documents")
    assert stored.count() == t.invoice_docs.count() and spark.read.parquet(f"{tmp_path}/table_cells").count() > 0
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, document_job.process(t.doc_lines, "2024-06-30").collect()), key=repr)


def test_export_sinks(spark, tmp_path):
    from ledgerlens.sources import export as X2

    docs = spark.createDataFrame([(1, "invoice"), (2, "receipt")], "doc_id long, type string")
    mapped = spark.createDataFrame([(1, 'say "x"', None), (2, "b;c", "d")], "doc_id long, A string, B string")
    X2.write_csv(mapped, f"{tmp_path}/csv", delimiter=";")
    back = spark.read.option("header", "true").option("sep", ";").option("escape", "\\").csv(f"{tmp_path}/csv").orderBy("doc_id").collect()
    assert [r["A"] for r in back] == ['say "x"', "b;c"]
    X2.write_json_export(X2.json_documents(docs, mapped, "now"), f"{tmp_path}/json", "e1", "now")
    assert spark.read.json(f"{tmp_path}/json/envelope").first()["document_count"] == 2
    for kind in ("jsonl", "csv", "parquet"):
        X2.write_records(mapped, f"{tmp_path}/{kind}-out", kind)
    assert spark.read.parquet(f"{tmp_path}/parquet-out").count() == 2
