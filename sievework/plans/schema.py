"""The schema of a table as rows, one for each column in the table's order, and conditions that select among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import inference


def table_schema(values: DataFrame, columns: list[str]) -> DataFrame:
    """What inference says of each column of a value dictionary, and its position from 0.  Columns that the dictionary
    does not have (an empty table has none) give no row."""
    placed = values.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column string")
    return inference.fused(values).join(F.broadcast(placed), "column")


def is_named(name: str) -> Column:
    return F.col("column") == name


def is_at(position: int) -> Column:
    return F.col("position") == position


def has_role(role: str) -> Column:
    return F.col("role") == role


def is_identifier() -> Column:
    """Columns that tell rows apart: of that role, without missing or repeated values."""
    return has_role("identifier") & F.col("is_unique") & ~F.col("nullable")
