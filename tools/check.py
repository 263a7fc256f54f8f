"""Compare registered queries with their SQL texts: `python tools/check.py [--sf 0.01] [name ...]`."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fieldspark.fixtures import TABLES  # noqa: E402
from fieldspark.registry import load_all  # noqa: E402
from fieldspark.session import build_session  # noqa: E402


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}={plain(x)}" for k, x in v.items()) + "}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, q, folder):
    """(problem or None, rows)"""
    df = q(spark, folder)
    got_cols, got = table(df.columns, df.collect())
    if q.sql is None:
        return (None if got else "no rows"), len(got)
    cur = con.execute(q.oracle())
    want_cols, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} vs {len(want)}; only spark {sorted(a)[:3]}; only sql {sorted(b)[:3]}", len(got)
    return (None if got else "no rows"), len(got)


def main():
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("--sf", default="0.01")
    args = p.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    every = load_all()
    bad = 0
    for name in args.names or every:
        start = time.time()
        try:
            problem, n = compare(spark, con, every[name], folder)
        except Exception as exc:
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", 0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:24s} {n:8d} rows {time.time() - start:6.2f} s {problem or ''}", flush=True)
    print(f"{bad} bad", flush=True)


if __name__ == "__main__":
    main()
