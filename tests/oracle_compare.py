"""Run registered queries against their DuckDB text: python tests/oracle_compare.py [sf] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata"


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads=4")
    for f in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    import datetime as dt
    import decimal

    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple(("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_names, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    secs = time.time() - t0
    if sql is None:
        return f"rows-only ({len(s_rows)})", secs
    rel = con.execute(sql)
    d_names = [d[0] for d in rel.description]
    d_names, d_rows = rows_of(d_names, rel.fetchall())
    if s_names != d_names:
        return f"COLUMNS {s_names} vs {d_names}", secs
    if len(s_rows) != len(d_rows):
        return f"ROWS {len(s_rows)} vs {len(d_rows)}", secs
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        a, b = bad[0]
        diffs = [(n, x, y) for n, x, y in zip(s_names, a, b) if x != y]
        return f"VALUES {len(bad)}/{len(s_rows)} differ, first {diffs} row {a}", secs
    return f"ok ({len(s_rows)})", secs


def main():
    from barledger.session import local_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            verdict, secs = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            verdict, secs = f"ERROR {type(exc).__name__}: {str(exc)[:600]}", 0.0
        failed += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:34s} {secs:6.2f}s {verdict}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
