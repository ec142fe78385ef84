"""Run a query and its DuckDB twin on one folder and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set threads=4")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or isinstance(v, (int, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder):
    start = time.time()
    df = fn(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return f"rows={len(got)} {took:.1f}s", True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns differ {sorted(df.columns)} {sorted(names)}", False
    types = dict(df.dtypes)
    duck = {d[0]: str(d[1]).lower() for d in cur.description}
    bad = [(c, types[c], duck[c]) for c in types
           if {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar",
               "boolean": "boolean"}.get(types[c], "?") != duck[c] ]
    note = f" TYPES{bad}" if bad else ""
    if got != want:
        gs, ws = set(map(repr, got)), set(map(repr, want))
        return (f"DIFF got={len(got)} want={len(want)} only_spark={sorted(gs - ws)[:3]} "
                f"only_duck={sorted(ws - gs)[:3]}{note}"), False
    return f"ok rows={len(got)} {took:.1f}s{note}", bool(got) and not bad


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pageloom.plans import ORACLES, QUERIES
    from pageloom.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            text, ok = compare(spark, con, name, fn, ORACLES.get(name), folder)
        except Exception as exc:  # report and go on to the next query
            text, ok = f"ERROR {type(exc).__name__} {str(exc)[:600]}", False
        bad += not ok
        print(("PASS " if ok else "FAIL ") + name, text, flush=True)
    print("failed:", bad)
