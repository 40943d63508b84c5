"""Run registered queries in Spark and their SQL in DuckDB, and compare the results value by value.

    python tools/check_oracles.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from voxfare.plans import catalog  # noqa: E402
from voxfare.plans.views import TABLES  # noqa: E402
from voxfare.session import build_session  # noqa: E402


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v) + 0.0)
    return str(v)


def normal(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("oracle-check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    oracles, bad = catalog.oracle_sql(), []
    for name, plan in catalog.queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = plan(spark, args.sf)
            got = normal(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # report and go on with the next query
            print(f"ERROR  {name}: {str(e)[:600]}")
            bad.append(name)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows   {name}: {len(got[1])} rows, {took:.2f}s")
            continue
        try:
            start = time.time()
            res = con.execute(oracles[name])
            want = normal([d[0] for d in res.description], res.fetchall())
            duck = time.time() - start
        except Exception as e:
            print(f"SQL    {name}: {str(e)[:600]}")
            bad.append(name)
            continue
        if got == want:
            print(f"ok     {name}: {len(got[1])} rows, {took:.2f}s (sql {duck:.2f}s)")
        else:
            bad.append(name)
            print(f"DIFF   {name}: {len(got[1])} / {len(want[1])} rows, {took:.2f}s; columns {got[0]} / {want[0]}")
            a, b = set(got[1]), set(want[1])
            for r in sorted(a - b)[:3]:
                print("   spark", str(r)[:400])
            for r in sorted(b - a)[:3]:
                print("   sql  ", str(r)[:400])
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
