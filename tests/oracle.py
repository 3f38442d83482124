"""Run a registered query and its SQL on the same files and compare all rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) and v != v:
        return "NaN"
    return v


def _bag(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], Counter(tuple(_cell(r[i]) for i in at) for r in rows)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, fn, sql, folder):
    """(problem or '', rows, spark seconds, sql seconds)"""
    t0 = time.monotonic()
    df = fn(spark, folder)
    rows = df.collect()
    t1 = time.monotonic()
    if sql is None:
        return ("" if rows else "no rows"), len(rows), t1 - t0, 0.0
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    t2 = time.monotonic()
    gc, g = _bag(df.columns, rows)
    wc, w = _bag(want_cols, want)
    if gc != wc:
        return f"columns {gc} != {wc}", len(rows), t1 - t0, t2 - t1
    types = {n: t for n, t in df.dtypes}
    bad = [
        f"{n}:{types[n]}/{t}" for n, t in zip(want_cols, want_types)
        if KIND.get(types[n], types[n]) != t and not (t in ("DATE",) and types[n] == "date")
    ]
    if g != w:
        extra, lack = list((g - w).elements())[:2], list((w - g).elements())[:2]
        return f"values: {len(rows)} rows vs {len(want)}; only ours {extra}; only sql {lack}; types {bad}", len(rows), t1 - t0, t2 - t1
    if bad:
        return f"types {bad}", len(rows), t1 - t0, t2 - t1
    return ("" if rows else "no rows"), len(rows), t1 - t0, t2 - t1


def main(argv):
    import __spark_entry__ as entry
    from hindsight.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    qs, os_ = entry.queries(), entry.oracle_sql()
    fails = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            p, n, a, b = compare(spark, con, fn, os_.get(name), folder)
        except Exception as ex:  # noqa: BLE001
            p, n, a, b = f"{type(ex).__name__}: {str(ex)[:700]}", -1, 0, 0
        fails += bool(p)
        tag = "FAIL" if p else ("ok" if name in os_ else "ok(rows)")
        print(f"{tag:8s} {name:28s} rows={n:<8d} spark={a:6.2f}s sql={b:5.2f}s {p}", flush=True)
    print(f"{fails} failing")


if __name__ == "__main__":
    main(sys.argv[1:])
