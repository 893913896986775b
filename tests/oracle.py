"""Runs registered queries on Spark and their SQL on DuckDB and compares all rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{base}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26].replace("+00:00", "")
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, base: str, name: str, run, sql: str | None) -> str:
    """An empty string if all is well."""
    df = run(spark, base)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if got is not None else "no rows"
    cur = con.execute(sql)
    want = cur.fetchall()
    columns = [c[0] for c in cur.description]
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return ""
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return f"{len(a)} rows against {len(b)}; only Spark: {sorted(sa - sb)[:3]}; only SQL: {sorted(sb - sa)[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from corvine.session import get_session

    base = sys.argv[1]
    only = sys.argv[2:]
    spark = get_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(base), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        began = time.time()
        try:
            why = compare(spark, con, base, name, run, sql.get(name))
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(why)
        print(f"{'BAD ' if why else 'ok  '} {name} {time.time() - began:.1f}s {'' if name in sql else '(no sql)'} {why}", flush=True)
    print("bad:", bad)
