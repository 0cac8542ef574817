"""Skewed and oversized groups against brute force, and the shape of plans."""

import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens import skew
from ledgerlens.operators import documents as D
from ledgerlens.operators import layout as L
from ledgerlens.operators import matching as M
from ledgerlens.plans.catalog import QUERIES

BOX = "page_id long, box_id long, text string, x_min double, y_min double, x_max double, y_max double"


def test_bucketed_window_equals_plain_window(spark):
    rnd = random.Random(1)
    rows = [(0 if rnd.random() < 0.5 else rnd.randrange(20), rnd.randrange(400), i, rnd.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t int, i int, x int")
    got = skew.bucketed_window(df, ["k"], ["t", "i"], F.floor(F.col("t") / 10), previous={"p": F.col("x")}, following={"n": F.col("x")}, running={"r": F.col("x")})
    w = Window.partitionBy("k").orderBy("t", "i")
    want = df.select("*", F.lag("x").over(w).alias("p"), F.lead("x").over(w).alias("n"), F.sum("x").over(w).alias("r"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_nested_parts_keep_everything(spark):
    df = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)], "k int, i int")
    out = skew.nested_parts(df, "k", "i", F.struct("i"), "items", part_size=50).collect()
    assert sorted(x["i"] for r in out for x in r["items"]) == list(range(900))
    assert len([r for r in out if r["k"] == 0]) > 5


def docs_and_fields(spark, n, keys, seed=3):
    rnd = random.Random(seed)
    docs = [(i, f"D{i}", "invoice" if i % 4 else "receipt", f"2024-01-{1 + rnd.randrange(28):02d}") for i in range(n)]
    fields = []
    for i in range(n):
        fields.append((i * 10, i, "number", f" N{0 if rnd.random() < 0.4 else rnd.randrange(keys)} "))
        fields.append((i * 10 + 1, i, "amount", f"{rnd.randrange(50)},0"))
    d = spark.createDataFrame(docs, "doc_id long, name string, type string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    f = spark.createDataFrame(fields, "field_id long, doc_id long, field_name string, field_value string")
    return d, f, docs, {i: (fields[2 * i][3].strip().lower(), float(fields[2 * i + 1][3].replace(",", ""))) for i in range(n)}


def greedy(docs, test, types=None, used=()):
    order = sorted((d for d in docs if (not types or d[2] in types) and d[0] not in used), key=lambda d: (d[3], d[0]))
    taken, out = set(used), []
    for a, b in itertools.combinations(order, 2):
        if a[0] not in taken and b[0] not in taken and test(a[0], b[0]):
            taken |= {a[0], b[0]}
            out.append((a[0], b[0]))
    return out


def test_auto_match_equals_the_greedy_loop(spark):
    d, f, docs, values = docs_and_fields(spark, 120, 12)
    rules = [M.MatchRule(1, [("number", "equals", "number"), ("amount", "greater_than", "amount")], ["invoice"], "2024-02"),
             M.MatchRule(2, [("Number ", "equals", "number")], [], "2024-01")]
    links = spark.createDataFrame([(1, 5), (1, 6)], "set_id long, document_id long")
    got = {(r["rule_id"], r["left_id"], r["right_id"]) for r in M.auto_match(d, f, links, rules).collect()}
    first = greedy(docs, lambda a, b: values[a][0] == values[b][0] and values[a][1] > values[b][1], ["invoice"], {5, 6})
    used = {5, 6} | {x for p in first for x in p}
    second = greedy(docs, lambda a, b: values[a][0] == values[b][0], None, used)
    assert got == {(1, *p) for p in first} | {(2, *p) for p in second}


def test_match_groups_count_pairs(spark):
    d, f, docs, values = docs_and_fields(spark, 200, 9)
    rule = M.MatchRule(1, [("number", "equals", "number")])
    pairs = M.match_groups(d, f, rule).agg(F.sum("pairs")).first()[0]
    assert pairs == sum(1 for a, b in itertools.combinations(range(200), 2) if values[a][0] == values[b][0])
    counts = M.preview_counts(d, M.MatchRule(1, [], ["invoice"])).first()
    inv = sum(1 for x in docs if x[2] == "invoice")
    assert (counts["evaluated_pairs"], counts["skipped_pairs"]) == (inv * (inv - 1) // 2, 200 * 199 // 2 - inv * (inv - 1) // 2)


def test_rule_without_equals_is_refused(spark):
    d, f, _, _ = docs_and_fields(spark, 5, 3)
    with pytest.raises(ValueError):
        M.rule_pairs(d, f, M.MatchRule(1, [("amount", "greater_than", "amount")]))


def test_similar_documents_with_a_hot_group(spark):
    d, f, docs, values = docs_and_fields(spark, 150, 10)
    d = d.withColumn("user_id", F.lit(1))
    vendor = f.where("field_name = 'number'").withColumn("field_name", F.lit("Vendor_Name"))
    got = {}
    for r in D.similar_documents(d, vendor, 3).collect():
        got.setdefault(r["doc_id"], []).append((r["rank"], r["similar_id"]))
    for x in docs:
        same = [y for y in docs if y[0] != x[0] and y[2] == x[2] and values[y[0]][0] == values[x[0]][0]]
        want = [y[0] for y in sorted(same, key=lambda y: (y[3], y[0]), reverse=True)[:3]]
        assert [s for _, s in sorted(got.get(x[0], []))] == want


def random_boxes(n, seed, pages=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rnd.randrange(900), rnd.randrange(900), rnd.choice([5, 40, 300]), rnd.choice([5, 20, 150])
        rows.append((i % pages, i, f"t{i}", float(x), float(y), float(x + w), float(y + h)))
    return rows


def is_near(a, b, limit=50.0):
    def gap(lo, hi):
        return min(abs(a[lo] - b[hi]), abs(b[lo] - a[hi]), abs((a[lo] + a[hi]) / 2 - (b[lo] + b[hi]) / 2))

    return gap(3, 5) < limit and gap(4, 6) < limit


def test_near_pairs(spark):
    rows = random_boxes(150, 5)
    got = {(r["a"], r["b"]) for r in L.near_pairs(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and is_near(a, b)}


def test_clusters_small_and_distributed_form(spark):
    rows = random_boxes(90, 7)
    want = {}
    for p in {r[0] for r in rows}:
        page = [r for r in rows if r[0] == p]
        used = set()
        for i, seed in enumerate(page):
            if i in used:
                continue
            cluster = [seed]
            used.add(i)
            for j in range(i + 1, len(page)):
                if j not in used and any(is_near(page[j], k) for k in cluster):
                    cluster.append(page[j])
                    used.add(j)
            want.update({c[1]: seed[1] for c in cluster})
    got = {r["box_id"]: r["cluster_id"] for r in L.cluster_boxes(spark.createDataFrame(rows, BOX)).collect()}
    assert got == want


def test_rows_exact(spark):
    rows = random_boxes(80, 9)
    want = {}
    for p in {r[0] for r in rows}:
        sums = []
        for r in [r for r in rows if r[0] == p]:
            y = (r[4] + r[6]) / 2
            i = next((i for i, s in enumerate(sums) if abs(y - sum(s) / len(s)) < 10), None)
            if i is None:
                sums.append([])
                i = len(sums) - 1
            sums[i].append(y)
            want[r[1]] = i
    assert {r["box_id"]: r["row_idx"] for r in L.row_groups_exact(spark.createDataFrame(rows, BOX)).collect()} == want


def test_repartitioning_changes_nothing(spark):
    rows = random_boxes(60, 11)
    df = spark.createDataFrame(rows, BOX)
    a = sorted(map(tuple, L.table_cells(df.repartition(1)).collect()), key=repr)
    random.Random(2).shuffle(rows)
    b = sorted(map(tuple, L.table_cells(spark.createDataFrame(rows, BOX).repartition(16)).collect()), key=repr)
    assert a == b


NATIVE = ["correction_statistics", "document_batch", "header_extraction", "field_checks", "table_cells", "similar_documents", "match_groups",
          "document_routing", "correction_session_audit", "box_neighbours", "validation_report", "semantic_search_batch"]


@pytest.mark.parametrize("name", NATIVE)
def test_plans_have_no_cross_join_or_python(spark, name):
    plan = QUERIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert bad not in plan


def test_filters_reach_the_scan(spark):
    plan = QUERIES["correction_statistics"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_no_local_checkpoint():
    root = Path(__file__).resolve().parents[1] / "ledgerlens"
    assert not [p for p in root.rglob("*.py") if "localCheckpoint" in p.read_text()]
