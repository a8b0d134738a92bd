"""The value dictionary: one aggregation of a table that every value-level check reuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import is_missing


def to_text(df: DataFrame, key: str) -> DataFrame:
    """All columns as text (null: empty) but the row key, which gives rows their order."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns if c != key]
    return df.select(F.col(key).cast("long").alias("_row_id"), *cells)


def spread_out(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as the session works on at once, where a small file gives fewer."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(least) if rows.rdd.getNumPartitions() < least else rows


def value_dictionary(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value, n, first_row, missing: a row for each distinct text of each column."""
    columns = columns or [c for c in rows.columns if c != "_row_id"]
    long = rows.unpivot("_row_id", columns, "column", "value")
    return long.groupBy("column", "value").agg(F.count("*").alias("n"), F.min("_row_id").alias("first_row")).withColumn("missing", is_missing(F.col("value")))


def frequent(values: DataFrame, k: int) -> DataFrame:
    """The k most frequent texts of each column, the earlier one first of equals."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "first_row"))
    return values.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Rows of one page at most, as the feature asks.
PAGE = 500


def page(rows: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """Rows of a page in the order of _row_id, with total_rows and has_more (rows follow the page)."""
    size = min(limit, PAGE)
    total = rows.count()
    return rows.orderBy("_row_id").offset(offset).limit(size).withColumn("total_rows", F.lit(total).cast("long")).withColumn("has_more", F.lit(offset + size < total))
