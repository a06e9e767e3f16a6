"""Compare named queries with their SQL on a folder of tables: ``python tests/check_oracle.py FOLDER [NAME ...]``."""

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return rows_of(df.columns, df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return rows_of(columns, result.fetchall())


def compare(spark, con, name, folder, queries, sql):
    """(matches, message, row count, seconds)."""
    start = time.time()
    columns, got = spark_rows(queries[name](spark, folder))
    seconds = time.time() - start
    if name not in sql:
        return len(got) > 0, "no SQL", len(got), seconds
    expected_columns, expected = sql_rows(con, sql[name])
    if columns != expected_columns:
        return False, f"columns {columns} != {expected_columns}", len(got), seconds
    if got != expected:
        extra = [r for r in got if r not in set(expected)][:2]
        missing = [r for r in expected if r not in set(got)][:2]
        return False, f"{len(got)} rows != {len(expected)}; extra {str(extra)[:700]}; missing {str(missing)[:700]}", len(got), seconds
    return True, "equal", len(got), seconds


def main():
    import tempfile

    import __spark_entry__ as entry
    from argotlog.session import session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = session(
        "check", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="16g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="argotlog-check-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            good, message, n, seconds = compare(spark, con, name, folder, queries, sql)
        except Exception as error:
            good, message, n, seconds = False, f"{type(error).__name__}: {str(error)[:900]}", -1, -1
        bad += not good
        print(f"{'ok ' if good else 'BAD'} {name:32s} {n:8d} rows {seconds:7.2f}s  {message}", flush=True)
    print(f"{bad} of {len(names or queries)} bad")


if __name__ == "__main__":
    main()
