"""Runs a registered query in Spark and its SQL in DuckDB and compares the values."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when columns, types of values and values agree."""
    left = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    right = _sorted_rows([d[0] for d in result.description], result.fetchall())
    problems = []
    if left[0] != right[0]:
        return [f"columns {left[0]} != {right[0]}"]
    if len(left[1]) != len(right[1]):
        problems.append(f"rows {len(left[1])} != {len(right[1])}")
    unequal = [(a, b) for a, b in zip(left[1], right[1]) if repr(a) != repr(b)]
    if unequal:
        problems.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return problems
