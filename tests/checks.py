"""Comparison of a Spark result with the check engine, shared by the tests and the command line."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from ledgerlens.plans.fixtures import BASE  # noqa: E402


def spark_session(cores: int = 8, memory: str = "8g"):
    from ledgerlens.session import build_session

    spark = build_session("checks", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory,
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


TIMES = [0.0, 0.0]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else the first difference."""
    start = time.time()
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    mid = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    TIMES[:] = [mid - start, time.time() - mid]
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}: {got[1][:2]} {want[1][:2]}"
    for a, b in zip(got[1], want[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {a} != {b}"
    return None


def main(argv: list[str]) -> None:
    from ledgerlens.plans.catalog import QUERIES

    sf = f"/root/testdata/sf{argv[0]}"
    names = argv[1:] or list(QUERIES)
    spark, con = spark_session(), duck(sf)
    bad = 0
    for n in names:
        q = QUERIES[n]
        start = time.time()
        try:
            df = q.run(spark, sf)
            if q.sql:
                issue = compare(df, con, q.sql)
            else:
                issue = None if df.count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            issue = f"{type(e).__name__}: {str(e)[:600]}"
        bad += issue is not None
        print(f"{'ok  ' if issue is None else 'BAD '} {n} {time.time() - start:.1f}s (spark {TIMES[0]:.1f}, sql {TIMES[1]:.1f}) {issue or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
