"""Run named queries next to their SQL oracles and compare rows.

Usage: python tools/check_oracles.py [--dir FOLDER] [--plan] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from libsight import session  # noqa: E402
from libsight.plans import ORACLES, QUERIES  # noqa: E402
from libsight.sources.fixtures import BASE  # noqa: E402


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def norm(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        return v
    return sorted([tuple(norm(r[i]) for i in order) for r in data], key=repr)


def compare(spark, con, name, folder):
    start = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLES:
        return f"rows-only {len(got)} rows", took, True
    start = time.time()
    rel = con.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    sql_took = time.time() - start
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", took, False
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    types = dict(df.dtypes)
    note = ""
    if b:
        kinds = dict(zip(cols, [str(d[1]) for d in rel.description]))
        clash = [(c, types[c], kinds[c]) for c in cols
                 if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                     "boolean": "BOOLEAN"}.get(types[c], "?") not in kinds[c].upper()]
        if clash:
            note = f"  TYPES {clash}"
    if a == b:
        return f"ok {len(a)} rows (sql {sql_took:.1f}s){note}", took, True
    only_a = [r for r in a if r not in set(b)][:3] if len(a) < 20000 else []
    only_b = [r for r in b if r not in set(a)][:3] if len(b) < 20000 else []
    return f"DIFF spark {len(a)} sql {len(b)}\n   spark {str(only_a)[:400]}\n   sql   {str(only_b)[:400]}{note}", took, False


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--plan", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = session.build(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.dir}/{t}.parquet'")
    bad = []
    names = [n for n in QUERIES if not args.names or any(n == a or n.startswith(a + "*") for a in args.names)]
    for name in names:
        try:
            if args.plan:
                print(f"=== {name}")
                QUERIES[name](spark, args.dir).explain("formatted")
                continue
            text, took, fine = compare(spark, con, name, args.dir)
        except Exception as error:  # report and go on with the next query
            text, took, fine = f"ERROR {type(error).__name__} {str(error)[:1500]}", 0, False
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if not fine:
            bad.append(name)
        print(f"{name:28s} {took:6.1f}s  {text}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
