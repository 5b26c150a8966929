"""Compare every registered query with its DuckDB oracle (as the driver does).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, schema (column names) and an order-insensitive
value hash match.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from biblioscope.session import build_session  # noqa: E402

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        t1 = time.time()
        if name not in sqls:
            print(f"{name:32s} spark_rows={len(srows)} (no oracle) {t1 - t0:.1f}s")
            continue
        rel = con.sql(sqls[name])
        dcols = rel.columns
        drows = rel.fetchall()
        ok_rows = len(srows) == len(drows)
        ok_cols = sorted(scols) == sorted(dcols)
        ok_hash = ok_cols and digest(scols, srows) == digest(dcols, drows)
        flag = "OK " if ok_rows and ok_cols and ok_hash else "BAD"
        bad += flag == "BAD"
        print(f"{flag} {name:32s} rows {len(srows)}/{len(drows)} cols={ok_cols} hash={ok_hash} {t1 - t0:.1f}s")
        if flag == "BAD" and ok_cols:
            order_s = [scols.index(c) for c in sorted(scols)]
            order_d = [dcols.index(c) for c in sorted(dcols)]
            ss = sorted("|".join(norm(r[i]) for i in order_s) for r in srows)
            dd = sorted("|".join(norm(r[i]) for i in order_d) for r in drows)
            print("   spark-only:", sorted(set(ss) - set(dd))[:5])
            print("   duck-only :", sorted(set(dd) - set(ss))[:5])
        elif not ok_cols:
            print("   spark cols:", scols, "duck cols:", dcols)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
