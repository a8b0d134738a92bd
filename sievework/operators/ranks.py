"""Exact order statistics by rounds of histograms: no sort, no task that holds all numbers, nothing but a row for each rank
on the driver.

A round cuts the range that holds a rank into BUCKETS parts of one width, sums weights by part, and keeps the part that the
rank falls in, with its own least and greatest number; two numbers are told apart when they are its only ends.  A round
leaves a BUCKETS-th of the range, so a few rounds do: three for a million evenly spread numbers.  Numbers that are not
finite stand at the ends: minus infinity first, then infinity and last those that are no number.
"""

from __future__ import annotations

from math import floor, inf, isinf, nan

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a range in one round.
BUCKETS = 4096
QUARTERS = (0.25, 0.5, 0.75)


def nearest(share: float, n: int) -> int:
    """The rank, from 0, nearest to a share of n numbers."""
    return floor(share * (n - 1) + 0.5)


def _part(v: Column) -> Column:
    """Which part of [low, high] a number lies in; halves are subtracted where the difference would be infinite."""
    half = F.when(F.col("wide"), 0.5).otherwise(1.0)
    share = (v * half - F.col("low") * half) / (F.col("high") * half - F.col("low") * half)
    return F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS))


def order_statistics(numbers: DataFrame, ranks: dict[str, list[int]] | None = None, shares: tuple[float, ...] = QUARTERS) -> dict[str, list[float]]:
    """Of each column of numbers (column, v and n, how often it is there) the numbers at some ranks from 0, or at the ranks
    nearest to shares.  A column without numbers is left out."""
    finite = F.abs(F.col("v")) < F.lit(inf)
    there = numbers.filter("v is not null")
    ends = there.groupBy("column").agg(F.min(F.when(finite, F.col("v"))).alias("low"), F.max(F.when(finite, F.col("v"))).alias("high"), F.sum(F.when(F.col("v") == -inf, F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(finite, F.col("n")).otherwise(0)).alias("finite"), F.sum(F.when(F.col("v") == inf, F.col("n")).otherwise(0)).alias("above"), F.sum("n").alias("n")).collect()
    wanted = {r["column"]: (ranks[r["column"]] if ranks else [nearest(s, r.n) for s in shares]) for r in ends if not ranks or r["column"] in ranks}
    found: dict[tuple[str, int], float] = {}
    open_: list[tuple[str, float, float, bool, int, list[int]]] = []
    for r in ends:
        inner = []
        for k in wanted.get(r["column"], []):
            if k < r.below:
                found[r["column"], k] = -inf
            elif k < r.below + r.finite:
                inner.append(k)
            else:
                found[r["column"], k] = inf if k < r.below + r.finite + r.above else nan
        _open(open_, found, r["column"], r.low, r.high, r.below, sorted(set(inner)))
    while open_:
        ranges = numbers.sparkSession.createDataFrame(list(enumerate(open_)), "id int, range struct<column:string,low:double,high:double,wide:boolean,before:bigint,ranks:array<bigint>>").select("id", "range.*")
        held = there.filter(finite).join(F.broadcast(ranges), "column").filter("v between low and high")
        parts = held.groupBy("id", "before", "ranks", _part(F.col("v")).alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        to = F.col("before") + F.sum("n").over(Window.partitionBy("id").orderBy("part"))
        kept = parts.withColumn("to", to).withColumn("mine", F.filter("ranks", lambda k: (k >= F.col("to") - F.col("n")) & (k < F.col("to")))).filter(F.size("mine") > 0)
        last, open_ = open_, []
        for r in kept.select("id", "low", "high", (F.col("to") - F.col("n")).alias("before"), "mine").collect():  # a row a rank at most
            _open(open_, found, last[r.id][0], r.low, r.high, r.before, list(r.mine))
    return {c: [found[c, k] for k in ks] for c, ks in wanted.items()}


def _open(open_: list, found: dict, column: str, low: float | None, high: float | None, before: int, ranks: list[int]) -> None:
    """Settle the ranks of a range of one number, or leave the range for another round."""
    if ranks and low == high:
        found.update(((column, k), low) for k in ranks)
    elif ranks:
        open_.append((column, low, high, isinf(high - low), before, ranks))


def quartiles(df: DataFrame, column: str) -> list[float] | None:
    """q1, median and q3 of a typed column, or none where it has no value."""
    numbers = df.select(F.lit(column).alias("column"), F.col(f"`{column}`").cast("double").alias("v"), F.lit(1).alias("n"))
    return order_statistics(numbers).get(column)
