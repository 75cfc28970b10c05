"""Run registered queries beside their check SQL and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracegauge.plans.corpus import BASE  # noqa: E402


def engine(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = round(value, 6)
        return int(value) if value == int(value) else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple(str(v) for v in r))


def compare(spark, con, sf_dir, name, fn, sql):
    """None when equal, else a short description."""
    df = fn(spark, sf_dir)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine[1] else "no rows"
    cur = con.execute(sql)
    theirs = table([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} <> {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"rows {len(mine[1])} <> {len(theirs[1])}; e.g. {mine[1][:2]} / {theirs[1][:2]}"
    if not mine[1]:
        return "no rows on either side"
    for a, b in zip(mine[1], theirs[1], strict=True):
        if a != b:
            return f"first difference {a} <> {b}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tracegauge.session import local_session

    sf = sys.argv[1]
    picks = sys.argv[2:]
    spark = local_session("8")
    con = engine(sf)
    checks, bad = oracle_sql(), 0
    start = time.time()
    for name, fn in queries().items():
        if picks and not any(p in name for p in picks):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, sf, name, fn, checks.get(name))
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time()-t:6.2f}s {'sql ' if name in checks else 'rows'} {name} {problem or ''}", flush=True)
    print(f"{bad} bad, {time.time()-start:.1f}s")
