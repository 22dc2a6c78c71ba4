"""Run registered queries and their SQL on the test tables and compare the rows.

    python tools/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, dt.datetime) and (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0):
        return v.date().isoformat()
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def compare(spark, con, fn, sql, sf_dir):
    """``(rows, problem or None)``."""
    df = fn(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(got_cols):
        return len(got), f"columns {sorted(got_cols)} != {sorted(cols)}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows, SQL has {len(want)}"
    a, b = canonical(got_cols, got), canonical(cols, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return len(got), f"{len(bad)} rows differ, first: {bad[0]}" if bad else "order"
    return len(got), None


def main():
    from fieldgrid.checks import catalog
    from fieldgrid.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [x for x in args if not x.startswith("/")]
    spark, con = local_session(8), connect(sf_dir)
    failed = []
    for name, fn in catalog.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            n, problem = compare(spark, con, fn, catalog.ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - a broken query is a finding, the run goes on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        label = "ok" if problem is None else "FAIL"
        print(f"{label:4} {name:45} rows={n:<8} {time.time() - start:6.2f}s {'' if name in catalog.ORACLES else '(rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
