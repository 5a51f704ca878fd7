"""Compare registered queries with their SQL on DuckDB: columns, row count, values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value + 0.0, 9) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, int):
        return repr(float(value))
    if type(value).__name__ == "Decimal":
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"ROWS   {name:34s} {len(got):7d} rows  {t1 - t0:5.1f}s", True
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    t2 = time.time()
    if sorted(got_cols) != sorted(want_cols):
        return f"SCHEMA {name}: {sorted(set(got_cols) ^ set(want_cols))}", False
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a == b:
        return f"OK     {name:34s} {len(a):7d} rows  {t1 - t0:5.1f}s duck {t2 - t1:.1f}s", True
    diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
    sa, sb = set(a), set(b)
    return (
        f"DIFF   {name}: {len(a)} vs {len(b)}; only spark {len(sa - sb)} only duck {len(sb - sa)}\n"
        f"   cols {sorted(got_cols)}\n   s {sorted(sa - sb)[:3]}\n   d {sorted(sb - sa)[:3]}"
    ), False


if __name__ == "__main__":
    import __spark_entry__ as entry
    from framejobs.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), duck(sf_dir)
    wanted = sys.argv[1:]
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), []
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            line, ok = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            line, ok = f"ERROR  {name}: {str(exc)[:1500]}", False
        print(line, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
