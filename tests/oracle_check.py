"""Compare every registered query with its SQL: names, row counts and values.

Usage: python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tagloom.queries import oracle_sql, queries  # noqa: E402
from tagloom.queries.common import TABLES  # noqa: E402


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(r[i]) for i in order) for r in data)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(folder: str, sql: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(sql)
    return rows([d[0] for d in result.description], result.fetchall())


def main(folder: str, only: list[str]) -> int:
    from conftest import make_session

    spark = make_session()
    bad = 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            got = spark_rows(query(spark, folder))
            want = duck_rows(folder, oracle_sql()[name])
            state = "ok" if got == want else "DIFFERENT"
        except Exception as error:
            state, got, want = f"ERROR {type(error).__name__}: {str(error)[:600]}", None, None
        print(f"{name:32s} {state}  {time.time() - start:.2f}s  rows={sum(got[1].values()) if got else '-'}")
        if state != "ok":
            bad += 1
            if got:
                print("  columns", got[0], want[0], "only here", list((got[1] - want[1]).items())[:3],
                      "only oracle", list((want[1] - got[1]).items())[:3])
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
