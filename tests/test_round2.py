"""Inputs that the derived tables do not hold: nulls, gaps, several requests for a field, limits."""

import threading

import pytest
from checks import duck
from pyspark.sql import functions as F

from ledgerlens import skew
from ledgerlens.functions import text as X
from ledgerlens.operators import corrections as C
from ledgerlens.operators import documents as D
from ledgerlens.operators import jobs as J
from ledgerlens.plans.catalog import QUERIES
from ledgerlens.sources import export as E


def test_windows_keep_rows_without_key_or_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 25, 3), (None, 7, 4), (None, None, 5)], "k string, t int, i int")
    got = {r.i: (r.rank, r.p) for r in skew.bucketed_window(
        df, ["k"], ["t", "i"], F.floor(F.col("t") / 10), previous={"p": F.col("i")}, running={"rank": F.lit(1).cast("long")}).collect()}
    assert got == {1: (1, None), 2: (2, 1), 3: (3, 2), 5: (1, None), 4: (2, 5)}


def test_one_key_with_half_of_the_rows_on_a_day(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    got = skew.rank_in_key(df, ["k"], ["t"], F.floor(F.col("t") / 100), "rank").where("k = 0").orderBy("t").collect()
    assert [r["rank"] for r in got] == list(range(1, 1501))


def test_pages_and_days_are_not_clamped(spark):
    df = spark.range(1500).select(F.col("id").alias("doc_id"), F.timestamp_seconds(F.col("id") * 8640).cast("timestamp_ntz").alias("created_at"))
    assert D.page_of(df, D.newest_first(), 1000).count() == 1000
    assert D.daily_counts(df, "1970-05-30", 100).agg(F.count("*"), F.sum("documents")).first() == (100, 1000)
    for wrong in (lambda: D.page_of(df, D.newest_first(), 0), lambda: D.page_of(df, D.newest_first(), 5, -1), lambda: D.daily_counts(df, "1970-05-30", 0)):
        with pytest.raises(ValueError):
            wrong()


def test_requeue_delay_keeps_doubling(spark):
    df = spark.range(1).select(*[J.requeue_seconds(F.lit(n)).alias(f"n{n}") for n in (0, 3, 30, 59, 60)], J.backoff_seconds(F.lit(2)).alias("b"), J.backoff_seconds(F.lit(90)).alias("top"))
    r = df.first()
    assert [r[f"n{n}"] for n in (0, 3, 30, 59, 60)] == [10, 80, 10 * 2**30, 10 * 2**59, None] and (r.b, r.top) == (10, 60)


def test_adjustments_are_clamped_one_by_one(spark):
    fields = spark.createDataFrame([(1, 7, "vat", "10", 0.9, False), (2, 7, "total", None, 0.2, False)], "doc_id long, field_id long, field_name string, field_value string, confidence double, is_edited boolean")
    fields = fields.withColumn("doc_id", F.lit(1).cast("long")).withColumn("field_id", F.when(F.col("field_name") == "vat", 7).otherwise(8).cast("long"))
    requests = spark.createDataFrame([(1, 1, "vat", "11", 0.5), (2, 1, "vat", None, -0.3), (3, 1, "vat", "12", 0.0), (4, 1, "total", "5", None), (5, 1, "none", "x", 0.1)],
                                     "request_id long, doc_id long, field_name string, corrected_value string, adj double").withColumn("confidence_adjustment", F.col("adj").cast("decimal(5,4)")).drop("adj")
    for block in (1, 2, 1000):
        new, records, errors = C.apply_batch(fields, requests, block)
        assert {r.field_name: (r.field_value, float(r.confidence)) for r in new.collect()} == {"vat": ("12", 0.7), "total": ("5", 0.2)}
        assert [(r.request_id, r.original_value, r.correction_type) for r in records.orderBy("request_id").collect()] == [
            (1, "10", "value_change"), (2, "11", "value_cleared"), (3, None, "value_added"), (4, None, "value_added")]
        assert [r.request_id for r in errors.collect()] == [5]


def test_line_items_count_from_one(spark):
    fields = spark.createDataFrame([(1, k, f"ITEM{n}_amount", str(n)) for k, n in enumerate(["0", "1", "2", "4"])] + [(2, 9, "ITEM01_amount", "1")], "doc_id long, field_id long, field_name string, field_value string")
    got = E.contiguous_items(E.item_columns(fields, "ITEM", ["amount"])).collect()
    assert sorted((r.doc_id, r.n) for r in got) == [(1, 1), (1, 2)]


def test_config_values_are_read_as_they_are(spark):
    given = ['1,"v":2', '"abc"', "12", '{"a":1}', "plain", "null", '"a" b', "1],[2", "1,2", "", None]
    got = [r.v for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, r string").orderBy("i").select(X.config_value("r", "none").alias("v")).collect()]
    assert got == ['1,"v":2', "abc", "12", '{"a":1}', "plain", "null", '"a" b', "1],[2", "1,2", "", "none"]


def test_similar_documents_without_vendor_or_type(spark):
    docs = spark.createDataFrame([(1, 1, "invoice", 1), (2, 1, "invoice", 2), (3, 1, "receipt", 3), (4, 1, "unknown", 4), (5, 2, "invoice", 5)], "doc_id long, user_id long, type string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    fields = spark.createDataFrame([(1, 1, "Vendor", "A"), (3, 2, "vendor_name", "A"), (4, 3, "vendor", "A"), (5, 4, "vendor", "A")], "doc_id long, field_id long, field_name string, field_value string")
    got = {(r.doc_id, r.similar_id) for r in D.similar_documents(docs, fields).collect()}
    # 1 and 3 have a vendor and a type, 2 has a type only, 4 a vendor only; 5 is another owner's.
    assert got == {(2, 1), (4, 1), (4, 3)}


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_check_sql_ends_under_a_limit(name):
    con = duck("/root/testdata/sf0.001")
    stop = threading.Timer(20, con.interrupt)
    stop.start()
    try:
        con.execute(f"select * from ({QUERIES[name].sql}) limit 2000000").fetchall()
    finally:
        stop.cancel()


def test_spans_place_cells_like_a_grid(spark):
    import random

    from ledgerlens.sources.html_tables import html_cells

    rng = random.Random(3)
    pages, want = [], set()
    for page in range(30):
        free, html = {}, "<table>"
        for r in range(rng.randint(1, 6)):
            html, c = html + "<tr>", 0
            for i in range(rng.randint(0, 5)):
                down, across = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 4])
                while free.get(c, 0) > r:
                    c += 1
                want.add((page, r, c, down, across, f"{r}.{i}"))
                html += f'<td rowspan="{down}" colspan="{across}">{r}.{i}</td>'
                for k in range(c, c + across):
                    free[k] = max(free.get(k, 0), r + down)
                c += across
            html += "</tr>"
        pages.append((page, html + "</table>"))
    got = html_cells(spark.createDataFrame(pages, "page int, html string"), "page").collect()
    assert {tuple(r) for r in got} == want


def test_scratch_is_dropped_by_its_owner(spark):
    from ledgerlens.session import drop_scratch, scratch_path

    path = scratch_path(spark, "t")
    spark.range(5).write.parquet(path)
    assert spark.read.parquet(path).count() == 5 and scratch_path(spark, "t") != path
    assert drop_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
