"""Compare Spark results with DuckDB results, order-insensitively."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(float(value)) else repr(float(value) + 0.0)
    if isinstance(value, int):
        return value
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    mine = spark_df.collect()
    cursor = con.execute(sql)
    theirs = cursor.fetchall()
    names = [c[0] for c in cursor.description]
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = rows_of(spark_df.columns, mine), rows_of(names, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}"
    kinds = {}
    for row in (a[0:1] and a):
        for i, value in enumerate(row):
            if value is not None:
                kinds.setdefault(i, set()).add(type(value).__name__)
    return None
