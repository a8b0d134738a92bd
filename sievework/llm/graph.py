"""Connected components of links, as joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import staged

#: Links that a task ties at once.
LINKS = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in links (columns a and b, of any order, repeated or not).

    Every task first ties what its own links connect to the smallest id there.  Then two steps alternate until all
    edges lead from a node to one that leads nowhere: every larger neighbour of a node is tied to the smallest one, then
    every smaller neighbour and the node itself.  Each round is written to the shared folder.  Edges that are no more
    than a task ties at once (LINKS rows of 16 bytes) are tied by one task, which ends the rounds.
    """
    started = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = staged(started.mapInArrow(_stars, "u long, v long").distinct(), "edges")
    while not _settled(edges):
        if edges.count() <= LINKS:
            edges = staged(edges.coalesce(1).mapInArrow(_stars, "u long, v long"), "edges")
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        ties = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = staged(ties.mapInArrow(_stars, "u long, v long").distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether every node leads to one node at most, and that one leads nowhere."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out")))
    return ends.groupBy("id").agg(F.sum("out").alias("n"), F.min("out").alias("least")).filter("n > 1 or (n = 1 and least = 0)").isEmpty()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each node to the smallest one that edges of this task (LINKS at once) connect it to."""
    held: list[pa.RecordBatch] = []

    def tied() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        nodes, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
        a, b = np.split(ends, 2)
        least = np.arange(len(nodes))
        while True:
            now = np.minimum(least[a], least[b])
            new = least.copy()
            for at in (a, b, least[a], least[b]):
                np.minimum.at(new, at, now)
            new = new[new]
            if (new == least).all():
                break
            least = new
        moved = least != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= LINKS:
            yield tied()
            held.clear()
    if held:
        yield tied()


def ties(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties of each id to the smallest one it is connected with inside this block."""
    keep_r, keep_c = linked.any(axis=1), linked.any(axis=0)
    linked, rows, columns = linked[np.ix_(keep_r, keep_c)], rows[keep_r], columns[keep_c]
    least_r, least_c = rows.copy(), columns.copy()
    far = np.iinfo(np.int64).max
    while len(rows):
        new_c = np.minimum(least_c, np.where(linked, least_r[:, None], far).min(axis=0))
        new_r = np.minimum(least_r, np.where(linked, new_c[None, :], far).min(axis=1))
        if (new_r == least_r).all() and (new_c == least_c).all():
            break
        least_r, least_c = new_r, new_c
    a, b = np.concatenate([rows, columns]), np.concatenate([least_r, least_c])
    return a[a != b], b[a != b]
