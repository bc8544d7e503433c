"""Runs a query in Spark and its SQL in DuckDB and compares all values."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    if isinstance(value, (int, Decimal)):
        return value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is not None, str(type(v)), v) for v in row))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _sorted_rows(df.columns, df.collect())


def sql_rows(db: duckdb.DuckDBPyConnection, statement: str) -> tuple[list[str], list[tuple]]:
    result = db.execute(statement)
    columns = [d[0] for d in result.description]
    return sorted(columns), _sorted_rows(columns, result.fetchall())


def difference(spark_side, sql_side) -> str | None:
    """None when both sides agree, else a short account of the first difference."""
    if spark_side[0] != sql_side[0]:
        return f"columns {spark_side[0]} != {sql_side[0]}"
    if len(spark_side[1]) != len(sql_side[1]):
        return f"{len(spark_side[1])} rows != {len(sql_side[1])}"
    for left, right in zip(spark_side[1], sql_side[1]):
        if left != right or [type(v) for v in left] != [type(v) for v in right]:
            return f"{spark_side[0]}: {left} != {right}"
    return None
