"""Compare queries with their SQL twins: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def shown(value) -> str:
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(shown(r[i]) for i in order) for r in rows)


def difference(spark, con, folder: str, query, sql: str | None) -> str | None:
    """None when equal, else a description. Without a twin the query only has to run."""
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} / {names}"
    if not expected:
        return "twin has no rows"
    a, b = rows_of(df.columns, got), rows_of(names, expected)
    if a == b:
        return None
    return (f"rows {len(got)} / {len(expected)}; columns {sorted(names)}\n"
            f"   only spark: {list((a - b).items())[:2]}\n   only twin : {list((b - a).items())[:2]}")


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    twins, bad = entry.oracle_sql(), 0
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, con, folder, entry.queries()[name], twins.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        note = "" if name in twins else " (rows only)"
        print(f"{'ok ' if problem is None else 'BAD'} {name}{note} {time.time() - started:.1f}s"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
