"""Spark-vs-DuckDB parity check for registered queries (mirrors the driver's gate).

usage: python tests/parity.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 5)
        return int(r) if r.is_integer() else r
    if isinstance(v, bool):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


def compare(spark, con, key, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = sdf.collect()
    ts = time.time() - t
    if sql is None:
        return dict(key=key, ok=None, rows=len(s_rows), spark_s=round(ts, 2))
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out = dict(key=key, rows=len(s_rows), oracle_rows=len(d_rows), spark_s=round(ts, 2))
    if sorted(s_cols) != sorted(d_cols):
        out.update(ok=False, why=f"cols spark-only {sorted(set(s_cols)-set(d_cols))} duck-only {sorted(set(d_cols)-set(s_cols))}")
        return out
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    bad_types = {c: (t, d_types[c]) for c, t in sdf.dtypes if SPARK_TO_DUCK.get(t, t) != d_types[c]}
    if bad_types:
        out.update(ok=False, why=f"types differ {bad_types}")
        return out
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    a = Counter(tuple(norm(r[i]) for i in si) for r in s_rows)
    b = Counter(tuple(norm(r[i]) for i in di) for r in d_rows)
    if a == b:
        out["ok"] = True
    else:
        only_a = list((a - b).elements())[:3]
        only_b = list((b - a).elements())[:3]
        out.update(ok=False, why=f"value mismatch; spark-only {only_a} duck-only {only_b}", cols=order)
    return out


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from rankline.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for k, fn in qs.items():
        if keys and k not in keys:
            continue
        try:
            r = compare(spark, con, k, fn, oracle.get(k), sf_dir)
        except Exception as e:  # report and continue
            r = dict(key=k, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
