"""Runs registered queries and their SQL on the same tables and compares the rows.

Usage: python tests/compare.py [folder] [name ...]
"""

import datetime
import decimal
import glob
import math
import os
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimal in a result")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of(arrow):
    names = sorted(arrow.column_names)
    columns = [[plain(v) for v in arrow.column(n).to_pylist()] for n in names]
    return names, sorted(zip(*columns), key=repr)


def difference(spark_rows, sql_rows):
    """None when equal, else a short description."""
    (names, left), (sql_names, right) = spark_rows, sql_rows
    if names != sql_names:
        return f"columns {names} / {sql_names}"
    if len(left) != len(right):
        return f"{len(left)} rows / {len(right)} rows; {left[:2]} / {right[:2]}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{names}: {str(a)[:600]} / {str(b)[:600]}"
    return None


def main():
    from pyspark.sql import SparkSession

    from tabloom.checks import load_registry

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_registry()
    db = connect(folder)
    failed = []
    for name in args[1:] or registry.queries:
        began = time.time()
        try:
            found = rows_of(registry.queries[name](spark, folder).toArrow())
            took = time.time() - began
            sql = registry.sql.get(name)
            problem = None if sql is None else difference(found, rows_of(db.execute(sql).to_arrow_table()))
            state = "rows only" if sql is None else "ok" if problem is None else "DIFFERS " + problem
            size = len(found[1])
            if problem or not size:
                failed.append(name)
        except Exception as error:  # noqa: BLE001
            took, state, size = time.time() - began, f"ERROR {type(error).__name__} {str(error)[:700]}", 0
            failed.append(name)
        print(f"{name:28s} {took:6.2f}s {size:8d} rows  {state}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
