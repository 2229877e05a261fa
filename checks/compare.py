"""Run registered queries beside their SQL and compare the rows.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\0"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def _kind(value) -> str:
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_cell(r[k]) for k in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    spark_columns, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    oracle_columns, oracle_rows = rows_of(names, cursor.fetchall())
    if spark_columns != oracle_columns:
        return False, f"columns {spark_columns} != {oracle_columns}"
    if len(spark_rows) != len(oracle_rows):
        return False, f"rows {len(spark_rows)} != {len(oracle_rows)}"
    for left, right in zip(spark_rows, oracle_rows):
        if left != right:
            return False, f"{left} != {right}"
    return True, f"{len(spark_rows)} rows"


def main(argv: list[str]) -> int:
    from checks import queries
    from faultline.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in argv[1:] or list(queries.QUERIES):
        start = time.time()
        try:
            df = queries.QUERIES[name](spark, sf_dir)
            if name in queries.ORACLES:
                good, note = compare(df, con, queries.ORACLES[name])
            else:
                good, note = True, f"{df.count()} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {note[:1800]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
