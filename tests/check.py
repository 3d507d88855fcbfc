"""Compare registered queries with their SQL on one scale: python tests/check.py [-s sf] [prefix…]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, con, name, fn, sql, sf):
    """Return (ok, message)."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(_norm(v) for v in r) for r in df.select(*cols).collect()]
    if sql is None:
        return True, f"{len(got)} rows (no SQL)"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return False, f"columns {cols} != {sorted(rel.columns)}"
    want = [tuple(_norm(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()]
    order = lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) else (False, "", x) for x in r)
    got.sort(key=order)
    want.sort(key=order)
    if got == want:
        return True, f"{len(got)} rows"
    if len(got) != len(want):
        return False, f"{len(got)} rows, SQL has {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return False, f"{len(bad)} of {len(got)} rows differ on {cols}; e.g.\n   {bad[0][0]}\n   {bad[0][1]}"


def main():
    args = sys.argv[1:]
    scale = "0.01"
    if args and args[0] == "-s":
        scale, args = args[1], args[2:]
    sf = f"/root/testdata/sf{scale}"
    from fleetwake.session import session
    import __spark_entry__ as entry

    spark = session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sqls, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            ok, msg = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
