"""Run a registered query in Spark and its SQL twin in DuckDB and compare."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, decimal.Decimal)):
        return str(int(value)) if value == int(value) else str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def _kind(values):
    for v in values:
        if v is not None:
            return "int" if isinstance(v, (int, decimal.Decimal)) and not isinstance(v, bool) \
                else type(v).__name__
    return None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(name, spark, sf_dir, con, queries, oracles):
    """None when equal, else a text that says what differs."""
    started = time.time()
    df = queries[name](spark, sf_dir)
    got_rows = df.collect()
    seconds = time.time() - started
    if name not in oracles:
        return None, len(got_rows), seconds
    result = con.execute(oracles[name])
    columns = [d[0] for d in result.description]
    want_rows = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got_rows), seconds
    for c in columns:
        a = _kind([r[df.columns.index(c)] for r in got_rows])
        b = _kind([r[columns.index(c)] for r in want_rows])
        if a is not None and b is not None and a != b:
            return f"type of {c}: {a} != {b}", len(got_rows), seconds
    got, want = rows_of(df.columns, got_rows), rows_of(columns, want_rows)
    if got == want:
        return None, len(got), seconds
    got_set, want_set = set(got), set(want)
    extra = [r for r in got if r not in want_set][:2]
    missing = [r for r in want if r not in got_set][:2]
    return (f"{len(got)} rows against {len(want)}\n   spark only {extra!r:.900}\n"
            f"   sql only {missing!r:.900}"), len(got), seconds


def main():
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    from graphloom.harness import ORACLES, QUERIES

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name in names:
        try:
            problem, n, seconds = compare(name, spark, sf_dir, con, QUERIES, ORACLES)
        except Exception as error:  # report and go on with the next query
            problem, n, seconds = f"{type(error).__name__}: {error!s:.1500}", 0, 0.0
        failed += problem is not None
        state = "ok  " if problem is None else "FAIL"
        kind = "sql" if name in ORACLES else "rows"
        print(f"{state} {name:28} {kind} {n:8} rows {seconds:6.2f}s", flush=True)
        if problem:
            print("  ", problem, flush=True)
    print(f"{len(names) - failed} of {len(names)} ok", flush=True)


if __name__ == "__main__":
    main()
