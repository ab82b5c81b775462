"""Run registered queries beside their SQL on DuckDB and compare. Also a command:

    python -m tests.oracle [folder] [name-prefix ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import threading
import time

import duckdb

from clearcharge.registry import all_queries
from clearcharge.registry.views import TABLES

SQL_SECONDS = 60
TIMES: dict[str, float] = {}  # Spark side only


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(str(_value(r[n])) for n in names) for r in df.collect())


def rows_of_duck(con, sql):
    stop = threading.Timer(SQL_SECONDS, con.interrupt)
    stop.start()
    try:
        cursor = con.execute(sql)
    finally:
        stop.cancel()
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(_value(r[i])) for i in order) for r in cursor.fetchall())


def compare(spark, con, folder, name):
    """None when equal, otherwise what differs."""
    queries, oracles = all_queries()
    started = time.time()
    names, got = rows_of_spark(queries[name](spark, folder))
    TIMES[name] = time.time() - started
    if name not in oracles:
        return None if names else "no columns"
    expected_names, expected = rows_of_duck(con, oracles[name])
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if got != expected:
        left, right = set(got), set(expected)
        return (f"{len(got)} rows against {len(expected)}; only here {sorted(left - right)[:2]}; only expected {sorted(right - left)[:2]}")
    return None if got else "EMPTY"


def main() -> int:
    from clearcharge.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in all_queries()[0]:
        if args and not any(name.startswith(a) for a in args):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {TIMES.get(name, 0):.1f}s of {time.time() - started:.1f}s {'' if problem is None else problem}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
