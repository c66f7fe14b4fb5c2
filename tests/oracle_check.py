"""Run registered queries in Spark and their SQL in DuckDB, and compare rows.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
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


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    return "null" if x is None else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql) -> str | None:
    """None if the two agree, else what differs."""
    df = fn(spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    extra = sorted(set(got[1]) - set(want[1]))[:3]
    missing = sorted(set(want[1]) - set(got[1]))[:3]
    cut = [[tuple(c[:150] for c in r) for r in rows] for rows in (extra, missing)]
    return f"rows {len(got[1])} vs {len(want[1])}\n  spark only {cut[0]}\n  duckdb only {cut[1]}"


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    spark = builder.config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), []
    for name in names:
        start = time.time()
        try:
            if name in oracle_sql():
                problem = compare(spark, con, sf_dir, queries()[name], oracle_sql()[name])
                note = "ok" if problem is None else "DIFFERS " + problem
            else:
                problem, note = None, f"rows only: {queries()[name](spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = note = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        if problem:
            failed.append(name)
        print(f"{name}: {note} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
