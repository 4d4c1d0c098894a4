"""Compare every registered query with its SQL: python tests/check_oracle.py SF [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from querylens.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    return str(value)


def canonical(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


# Spark type -> DuckDB type.
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def compare(spark, con, sf_dir: str, run, sql: str) -> str:
    """'' when rows and column names agree, else what differs."""
    df = run(spark, sf_dir)
    got = canonical(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = canonical(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    theirs = {c[0]: str(c[1]) for c in cursor.description}
    types = [
        (name, kind, theirs[name]) for name, kind in df.dtypes if SAME_TYPE[kind] != theirs[name]
    ]
    if types:
        return f"types {types}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"rows {len(got)} != {len(want)}; {diff}"
    return "" if got else "EMPTY"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            verdict = compare(spark, con, sf_dir, queries()[name], oracle_sql()[name])
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__} {str(error)[:300]}"
        failed += bool(verdict)
        print(f"{'ok  ' if not verdict else 'FAIL'} {name} {time.time() - started:.1f}s {verdict[:900]}",
              flush=True)
    print("failed", failed, "of", len(names))
    return failed


if __name__ == "__main__":
    sys.exit(main())
