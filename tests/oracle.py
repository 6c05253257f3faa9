"""Run registered queries against DuckDB and compare values."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, tuple) else (False, "t", str(x)) for x in r))


def compare(spark, con, name, fn, sql, folder):
    """Return (ok, message)."""
    start = time.time()
    df = fn(spark, folder)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"{name}: rows-only {len(got)} in {took:.2f}s"
    rel = con.sql(sql)
    want = rel.fetchall()
    gn, g = rows_of(df.columns, got)
    wn, w = rows_of(rel.columns, want)
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    stypes = dict(df.dtypes)
    if gn != wn:
        return False, f"{name}: columns {gn} vs {wn}"
    if len(g) != len(w):
        return False, f"{name}: {len(g)} rows vs {len(w)}\n  got {g[:2]}\n  want {w[:2]}"
    if not g:
        return False, f"{name}: EMPTY"
    for a, b in zip(g, w):
        if a != b:
            return False, f"{name}: first difference\n  cols {gn}\n  got  {a}\n  want {b}"
    odd = [c for c in df.columns if any(x in types[c] for x in ("HUGEINT", "DECIMAL")) or "decimal" in stypes[c]]
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd += [f"{c}:{stypes[c]}/{types[c]}" for c in df.columns if stypes[c] in simple and simple[stypes[c]] != types[c]]
    note = f" TYPES {odd}" if odd else ""
    return not odd, f"{name}: ok {len(g)} rows in {took:.2f}s{note}"


if __name__ == "__main__":
    from seguelake import queries as q
    from seguelake.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    q.load_all()
    spark = local_session()
    if os.environ.get("HOT_ROWS"):
        # treat groups above this size as too large for one task
        spark.conf.set("seguelake.hotGroupRows", os.environ["HOT_ROWS"])
    con = connect(folder)
    bad = 0
    for name, fn in q.QUERIES.items():
        if only and name not in only and not any(o.endswith(".py") and o[:-3] == q.GROUP[name] for o in only):
            continue
        try:
            ok, msg = compare(spark, con, name, fn, q.SQL.get(name), folder)
        except Exception as exc:  # noqa: BLE001
            ok, msg = False, f"{name}: ERROR {type(exc).__name__} {str(exc)[:600]}"
        bad += not ok
        print(("    " if ok else "BAD ") + msg, flush=True)
    print("failed:", bad)
