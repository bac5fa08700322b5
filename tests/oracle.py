"""Runs every query and its SQL side by side; used by the tests and from the command line.

    python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, df.collect())
    if sql is None:
        return "rows-only", len(left[1])
    rel = con.sql(sql)
    right = rows_of(rel.columns, rel.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}", 0
    if left[1] != right[1]:
        diff = [(a, b) for a, b in zip(left[1], right[1]) if a != b][:2]
        return f"{len(left[1])} vs {len(right[1])} rows, first differences {diff}", 0
    kinds = [type(v).__name__ for v in (left[1][0] if left[1] else ())]
    other = [type(v).__name__ for v in (right[1][0] if right[1] else ())]
    if kinds != other and "NoneType" not in kinds + other:
        return f"types {kinds} != {other}", len(left[1])
    return "ok", len(left[1])


def main(sf_dir, *only):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            status, n = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            status, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        bad += status not in ("ok", "rows-only")
        print(f"{name:24} {n:8} {time.time() - started:6.2f}s {status}", flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
