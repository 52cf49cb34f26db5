"""Run registered queries beside their check SQL: ``python tests/oracle.py [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from racebook.sources.tables import TABLES

SF = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")


def connect(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def compare(spark, con, name: str, fn, sql: str | None, sf: str = SF):
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    cols = df.columns
    if sql is None:
        return ("ROWS" if rows else "EMPTY"), f"{len(rows)} rows", took
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    if sorted(cols) != sorted(ocols):
        return "COLS", f"{sorted(set(cols) ^ set(ocols))}", took
    idx, oidx = [cols.index(c) for c in sorted(cols)], [ocols.index(c) for c in sorted(ocols)]
    a = sorted(tuple(plain(r[i]) for i in idx) for r in rows)
    b = sorted(tuple(plain(r[i]) for i in oidx) for r in cur.fetchall())
    if a == b:
        return ("OK" if a else "EMPTY"), f"{len(a)} rows", took
    sa, sb = set(a), set(b)
    return "DIFF", f"{len(a)} vs {len(b)} {sorted(cols)}\n   spark {sorted(sa - sb)[:2]}\n   sql   {sorted(sb - sa)[:2]}\n   only {len(sa - sb)} / {len(sb - sa)}", took


if __name__ == "__main__":
    import __spark_entry__ as e
    from racebook.session import build_session

    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(), e.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            state, note, took = compare(spark, con, name, fn, oracles.get(name))
        except Exception as ex:  # report and go on with the next query
            state, note, took = "FAIL", str(ex)[:700], 0
        bad += state not in ("OK", "ROWS")
        print(f"{state:6} {name:32} {took:6.2f}s {note}", flush=True)
    print("not ok:", bad)
