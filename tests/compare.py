"""Runs a query and its SQL side by side on the supplied tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((value is None, "nan" if isinstance(value, float) and math.isnan(value) else str(value)) for value in row)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, types and rows agree."""
    result = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(result.columns):
        return [f"columns {names} and {sorted(result.columns)}"]
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    sql_types = dict(zip(result.columns, map(str, result.types)))
    problems = [f"type of {n}: {spark_types[n]} and {sql_types[n]}" for n in names if spark_types[n] != sql_types[n]]
    mine = sorted((tuple(row[n] for n in names) for row in df.collect()), key=_key)
    order = [result.columns.index(n) for n in names]
    theirs = sorted((tuple(row[i] for i in order) for row in result.fetchall()), key=_key)
    if len(mine) != len(theirs):
        return [*problems, f"rows {len(mine)} and {len(theirs)}"]
    bad = [(a, b) for a, b in zip(mine, theirs) if _key(a) != _key(b)]
    if bad:
        problems.append(f"{len(bad)} of {len(mine)} rows differ in {names}, first {str(bad[0][0])[:300]} and {str(bad[0][1])[:300]}")
    return problems
