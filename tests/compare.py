"""Run a registered query and its SQL counterpart and compare the rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from collections import Counter

import duckdb


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


_KINDS = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE",
          "StringType": "VARCHAR", "BooleanType": "BOOLEAN"}


def compare(spark_result, connection, sql: str) -> str:
    """Empty if equal as multisets of rows, names and types; else a message."""
    executed = connection.execute(sql)
    theirs = {d[0]: str(d[1]) for d in executed.description}
    expected = executed.fetchall()
    ours = {f.name: type(f.dataType).__name__ for f in spark_result.schema}
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} != {sorted(theirs)}"
    kinds = {c: (_KINDS[t], theirs[c]) for c, t in ours.items() if _KINDS[t] != theirs[c]}
    if kinds:
        return f"types {kinds}"
    a = _multiset(spark_result.columns, spark_result.collect())
    b = _multiset(list(theirs), expected)
    if a != b:
        extra, missing = a - b, b - a
        return (
            f"{sum(extra.values())} extra such as {list(extra)[:2]},"
            f" {sum(missing.values())} missing such as {list(missing)[:2]}"
        )
    return ""
