"""Runs registered queries against their SQL and compares the rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else (f"{value:.9g}" if value else "0")
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(value).isoformat()
    return str(value)


def normalized(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, folder: str, name: str, make, sql: str, con) -> str | None:
    """None when both sides agree, else what is different."""
    result = make(spark, folder)
    got_names = result.columns
    got = normalized(got_names, [tuple(r) for r in result.collect()])
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = normalized(want_names, cursor.fetchall())
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {got[:2]} / {want[:2]}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ: {wrong[0][0]} / {wrong[0][1]}"
    if not got and "empty" not in name:
        return "no rows"
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as registered
    from tests.conftest import make_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_session(), connection(folder)
    queries, sql = registered.queries(), registered.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    print("only queries:", sorted(set(queries) - set(sql)), "only SQL:", sorted(set(sql) - set(queries)))
    failed = []
    for name in wanted:
        start = time.time()
        try:
            found = difference(spark, folder, name, queries[name], sql[name], con)
        except Exception as error:
            found = f"{type(error).__name__}: {str(error)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if found:
            failed.append(name)
        print(f"{time.time() - start:6.2f}s {name}: {found or 'ok'}", flush=True)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
