"""Side-by-side check of the registered plans against their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 9) + 0.0
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, plan, sql: str, sf_dir: str):
    """Returns (problem or '', row count, Spark seconds, DuckDB seconds)."""
    start = time.time()
    frame = plan(spark, sf_dir)
    got_cols, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    middle = time.time()
    if sql is None:
        return "", len(got), middle - start, 0.0
    relation = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in relation.description], relation.fetchall())
    end = time.time()
    problem = ""
    if got_cols != want_cols:
        problem = f"columns {got_cols} != {want_cols}"
    elif len(got) != len(want):
        problem = f"rows {len(got)} != {len(want)}"
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problem = f"{len(bad)} rows differ, first {bad[0]}"
    return problem, len(got), middle - start, end - middle


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from sitelake.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    plans, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in plans.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            problem, n, t_spark, t_duck = compare(spark, con, plan, oracles.get(name), folder)
        except Exception as error:  # report and go on with the next query
            problem, n, t_spark, t_duck = f"{type(error).__name__}: {str(error)[:600]}", -1, 0, 0
        mark = "BAD" if problem else ("ok " if name in oracles else "ok-nosql")
        bad += bool(problem)
        print(f"{mark} {name} rows={n} spark={t_spark:.1f}s duck={t_duck:.1f}s {problem[:900]}", flush=True)
    print("problems:", bad)
