"""Comparison of a Spark result with DuckDB's over the same Parquet tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value in a form that both engines share."""
    if value is None or isinstance(value, (bool, str, bytes)):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        x = float(value)
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def table(columns: list[str], rows: list) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr([plain(r[k]) for k in order]) for r in rows)


def of_spark(df: DataFrame) -> tuple[list[str], list[str]]:
    return table(df.columns, df.collect())


def of_duckdb(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    found = con.execute(sql)
    return table([c[0] for c in found.description], found.fetchall())
