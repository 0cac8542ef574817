"""Several tables on a page, the table function, statistics by method."""

import random

from ledgerlens.operators import layout as L
from ledgerlens.sources import table_rows

BOX = "page_id long, box_id long, text string, x_min double, y_min double, x_max double, y_max double"


def grid(page, first, texts, x, y):
    """Boxes of a table whose rows are 30 apart and whose columns are 80 apart."""
    width = len(texts[0])
    return [(page, first + r * width + c, t, x + 80.0 * c, y + 30.0 * r, x + 80.0 * c + 60, y + 30.0 * r + 20)
            for r, row in enumerate(texts) for c, t in enumerate(row)]


LEFT = [["Item", "Qty"], ["Bolt", "4"], ["Nut", "x"]]
RIGHT = [["Description", "Amount"], ["Paper", "1.50"], ["Ink", "20"], ["Pen", "3"]]
BELOW = [["Name", "Total"], ["Sum", "9"]]


def pages():
    one = grid(1, 0, LEFT, 10, 10) + grid(1, 100, RIGHT, 500, 10) + grid(1, 200, BELOW, 10, 400)
    return one + grid(2, 0, RIGHT, 10, 10) + [(2, 500, "page 2", 10.0, 900.0, 60.0, 920.0)] + [(None, i, "t", 0.0, 0.0, 1.0, 1.0) for i in range(5)]


def test_each_cluster_is_a_table(spark):
    rows = pages()
    random.Random(3).shuffle(rows)
    found = L.page_tables(spark.createDataFrame(rows, BOX).repartition(5))
    tables = {(r.page_id, r.cluster_id): r for r in found.tables.collect()}
    assert {k: (r["columns"], r["rows"], r["cells"]) for k, r in tables.items()} == {
        (1, 0): (2, 2, 4), (1, 100): (2, 3, 6), (1, 200): (2, 1, 2), (2, 0): (2, 3, 6)}
    assert tables[1, 100].rx_min == 500.0 and tables[1, 200].ry_min == 400.0 and abs(tables[1, 0].table_confidence - 0.2) < 1e-9
    cells = {(r.page_id, r.cluster_id, r.row_idx, r.col_idx): (r.standard_name, r.value, r.is_valid) for r in found.cells.collect()}
    want = {}
    for (page, first), texts, names in [((1, 0), LEFT, ["item_name", "quantity"]), ((1, 100), RIGHT, ["description", "amount"]),
                                        ((1, 200), BELOW, ["item_name", "amount"]), ((2, 0), RIGHT, ["description", "amount"])]:
        for r, row in enumerate(texts[1:], 1):
            for c, t in enumerate(row):
                want[page, first, r, c] = (names[c], t, t != "x")
    assert cells == want


def test_rates_count_rows_of_tables_that_name_the_column(spark):
    rates = {r.standard_name: r for r in L.column_detection(L.page_tables(spark.createDataFrame(pages(), BOX))).collect()}
    assert {n: (r.possible, r.extracted, r.detection_rate) for n, r in rates.items()} == {
        "item_name": (3, 3, 1.0), "quantity": (2, 2, 1.0), "description": (6, 6, 1.0), "amount": (7, 7, 1.0)}
    assert abs(rates["quantity"].avg_confidence - (0.95 + 0.1) / 2) < 1e-9


def test_tables_of_nothing(spark):
    found = L.page_tables(spark.createDataFrame([], BOX))
    assert found.tables.count() == found.cells.count() == found.columns.count() == 0
    # a header alone, and boxes without a place
    rows = [(1, i, "Item", 10.0 + 80 * i, 10.0, 70.0 + 80 * i, 30.0) for i in range(4)] + [(2, i, "Item", None, None, None, None) for i in range(4)]
    t = L.page_tables(spark.createDataFrame(rows, BOX)).tables.collect()
    assert [(r.page_id, r["columns"], r["rows"], r.overall_confidence) for r in t] == [(1, 4, 0, 0.0)]


def test_table_function(spark):
    table_rows.register(spark)
    cells = L.page_tables(spark.createDataFrame(pages(), BOX)).cells
    args = "table(select page_id, cluster_id, row_idx, col_idx, standard_name, value, confidence from {cells})"
    rows = spark.sql(f"select * from table_rows({args} partition by (page_id, cluster_id) order by (row_idx, col_idx))", cells=cells).collect()
    got = {(r.page_id, r.cluster_id, r.row_idx, n, v) for r in rows for n, v in r.cells.items()}
    assert got == {(r.page_id, r.cluster_id, r.row_idx, r.standard_name, r.value) for r in cells.collect()}
    mean = {(r.page_id, r.cluster_id, r.row_idx): r.row_confidence for r in L.row_confidence(cells, L.TABLE).collect()}
    assert {(r.page_id, r.cluster_id, r.row_idx): r.row_confidence for r in rows} == mean
    assert spark.sql(f"select * from table_rows({args} partition by (page_id, cluster_id) order by (row_idx, col_idx))", cells=cells.where("false")).count() == 0


def test_methods(spark):
    rows = [("amount", "alignment", 0.95), ("amount", "alignment", 0.1), ("amount", "named_field", None), ("quantity", "named_field", 0.5)]
    got = {(r.standard_name, r.method): (r.total_extracted, r.avg_confidence)
           for r in L.method_statistics(spark.createDataFrame(rows, "standard_name string, method string, confidence double")).collect()}
    assert got == {("amount", "alignment"): (2, 0.525), ("amount", "named_field"): (1, None), ("quantity", "named_field"): (1, 0.5)}
