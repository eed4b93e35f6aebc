"""Run every query on Spark and its SQL on DuckDB over the same files, and compare.

    python tools/check_queries.py SF_DIR [name ...]
"""
from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return True, f"{len(got)} rows (no SQL)", took
    res = con.execute(sql)
    want, want_cols = rows_of([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", took
    if got != want:
        wanted, found = set(want), set(got)
        extra, missing = [r for r in got if r not in wanted][:3], [r for r in want if r not in found][:3]
        return False, f"{len(got)} rows vs {len(want)}\n   cols {got_cols}\n   extra {extra}\n   missing {missing}", took
    return True, f"{len(got)} rows", took


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
       .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from gate import registry

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(registry.QUERIES)
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note, took = compare(spark, con, name, registry.QUERIES[name], registry.SQL.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
