"""Pages worked on where their boxes lie: the same results as by joins, a row per box, nothing per table broadcast."""

import contextlib
import io
import random

import pytest

from ledgerlens.operators import layout as L

BOX = "page_id long, box_id long, text string, x_min double, y_min double, x_max double, y_max double"


def boxes(pages=7, most=40):
    draw = random.Random(5)
    out = []
    for p in range(pages):
        for b in draw.sample(range(1000), draw.randint(1, most)):
            x, y = draw.uniform(0, 600), draw.uniform(0, 600)
            out.append((p, b, draw.choice(["Item", "Qty 3", "12.50", None]), x, y, x + draw.uniform(1, 60), y + 20.0))
    return out


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "9")
    yield
    spark.conf.set(name, before)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def by_hand(given):
    """(cluster, neighbours) of each box, one after the other."""

    def gap(a, b, low, high):
        return min(abs(a[low] - b[high]), abs(b[low] - a[high]), abs((a[low] + a[high]) / 2 - (b[low] + b[high]) / 2))

    out = {}
    for b in sorted(given, key=lambda r: r[:2]):
        near = [a for a in given if a[0] == b[0] and a[1] != b[1] and gap(a, b, 3, 5) < L.NEAR and gap(a, b, 4, 6) < L.NEAR]
        out[b[:2]] = (min([out[a[:2]][0] for a in near if a[1] < b[1]], default=b[1]), len(near))
    return out


@pytest.mark.parametrize("most", [15, 1000])
def test_clusters_and_neighbours_do_not_depend_on_the_size_of_a_page(spark, monkeypatch, small_batches, most):
    given = boxes()
    want = by_hand(given)
    monkeypatch.setattr(L, "PAGE_BOXES", most)
    df = spark.createDataFrame(given, BOX)
    assert rows(L.cluster_boxes(df)) == sorted(((p, b, c) for (p, b), (c, _) in want.items()), key=repr)
    assert rows(L.neighbour_counts(df)) == sorted(((p, b, n) for (p, b), (_, n) in want.items()), key=repr)


@pytest.mark.parametrize("most", [0, 1000])
def test_repeated_boxes_and_nulls_have_a_row_each(spark, monkeypatch, most):
    monkeypatch.setattr(L, "PAGE_BOXES", most)
    one, two = (1, 1, "a", 0.0, 0.0, 10.0, 10.0), (1, 2, "b", 20.0, 0.0, 30.0, 10.0)
    lone, nowhere = (1, 3, "c", 900.0, 0.0, 910.0, 10.0), (1, 4, "d", None, 0.0, 10.0, 10.0)
    given = spark.createDataFrame([one, one, two, two, lone, nowhere, (None, 5, "e", 0.0, 0.0, 1.0, 1.0)], BOX)
    assert rows(L.cluster_boxes(given)) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1), (1, 3, 3), (1, 4, 4)]
    assert rows(L.clustered(given).select("page_id", "box_id", "cluster_id")) == rows(L.cluster_boxes(given))
    assert rows(L.neighbour_counts(given)) == [(1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 2, 3), (1, 3, 0)]


def test_frames_with_a_row_per_table_are_not_broadcast_and_cells_are_read_once(spark):
    given = spark.createDataFrame(boxes(), BOX)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        L.column_statistics(L.table_cells(given)).explain()
    assert "Broadcast" not in text.getvalue()
    assert text.getvalue().count("hashpartitioning(page_id") <= 2  # cells and header columns
    found = {r.standard_name: r for r in L.column_statistics(L.table_cells(given)).collect()}
    cells = L.table_cells(given).collect()
    assert {r.total_rows for r in found.values()} == {len({(c.page_id, c.row_idx) for c in cells})}
    assert sum(r.total_extracted for r in found.values()) == len(cells)
