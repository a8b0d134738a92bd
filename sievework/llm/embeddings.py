"""Embedding near-duplicates by an exact metric range join.

Vectors are scaled to length 1, where a cosine of at least c is a distance of at most r = sqrt(2 - 2c).  Pivots cut
the space into cells of the vectors nearest to each.  A vector also goes to every cell that may hold one within r of
it: by the triangle inequality it must be within r of the cell's radius, and within r of the plane halfway to that
pivot.  Of two cells that reach each other one compares their vectors, so that every pair is compared once and counts for
both.  Cells are cut into blocks, and pairs of blocks are dealt to rounds that move ROUND copies of each vector at most and
are written before the next one starts, so that the disk follows the number of vectors and not that of pairs.
The number of pivots is the one of least expected work on a bounded sample: where no pivot separates vectors (independent
directions in many dimensions), one cell is joined block by block, and the comparisons grow with the square of the rows.

Defined cases: null or zero vectors, and those with null, NaN or infinite components, have no links and are their own
component; a shorter vector counts as padded with zeros; equal vectors are joined once and count as links of each
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sievework.llm.graph import components, ties
from sievework.llm.shared import drop_folder, hash_sample, new_folder, staged

COSINE = 0.9
#: Rows of the sample that pivots are chosen on; bytes of pivots that tasks get; rows of a block at least and at most; rows
#: of it that are compared at once; comparisons that take as long as one copy of a vector.
SAMPLE, PIVOT_BYTES, SMALL_BLOCK, BLOCK, AT_ONCE, COPY = 2000, 4 << 20, 2048, 16384, 256, 2000
#: Copies of vectors that a round moves, as a multiple of the vectors (a pair of blocks at least).
ROUND = 2
#: How far a cosine in single precision may be off, with room to spare.
NEAR = 1e-4


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of length 1 in double precision, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def _reached(d: np.ndarray, between: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """Which cells each vector goes to, its own among them."""
    home = d.argmin(axis=1)
    own = d[np.arange(len(d)), home]
    gap = np.maximum(between[home], 1e-12)
    out = (d <= radius + r + 1e-9) & ((d * d - (own * own)[:, None]) / (2 * gap) <= r + 1e-9)
    out[np.arange(len(d)), home] = True
    return out


def choose_pivots(x: np.ndarray, n: int, r: float) -> np.ndarray:
    """Pivots out of the sample x of n vectors: the number with the least work, in comparisons and copies."""
    best = (float("inf"), x[:1])
    number, size = 1, _block(n)
    while number <= len(x) and number * x.shape[1] * 8 <= PIVOT_BYTES:
        pivots = x[:number]
        d = _distances(x, pivots)
        radius = np.zeros(number)
        np.maximum.at(radius, d.argmin(axis=1), d.min(axis=1))
        foreign = (_reached(d, _distances(pivots, pivots), radius, r).sum() / len(x) - 1) / 2
        own = n / number
        down, across = np.ceil(own / size), np.ceil(own * foreign / size)
        work = own / 2 + own * foreign + COPY * (down + across + down * foreign) + number
        best = min(best, (work, pivots), key=lambda b: b[0])
        number *= 2
    return best[1]


def _block(n: int) -> int:
    return min(BLOCK, max(SMALL_BLOCK, n // 12))


def _half(to: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Of the cells that vectors reach, those that compare them: of two cells the one up to half the circle below."""
    number = to.shape[1]
    cell = np.arange(number)
    off = (home[:, None] - cell) % number
    return to & (off > 0) & ((2 * off < number) | ((2 * off == number) & (cell < home[:, None])))


def rounds(cells: list[tuple[int, int, int]], size: int, most: float) -> Iterator[list[tuple[int, int, int, int]]]:
    """Rounds of (cell, i, low, high): block i of a cell (cell, own, foreign rows) meets blocks low to high - 1 of it, its
    own ones from i on and then the foreign ones.  A round moves about `most` rows, or one pair of blocks."""
    held: list[tuple[int, int, int, int]] = []
    load = 0.0
    for cell, own, foreign in cells:
        down, across = -(-own // size), -(-foreign // size)
        for i in range(down):
            low = i
            for j in range(i, down + across):
                moved = own / down + (0 if j == i else own / down if j < down else foreign / across)
                if load and load + moved > most:
                    if j > low:
                        held.append((cell, i, low, j))
                    yield held
                    held, load, low = [], 0.0, j
                load += moved
            held.append((cell, i, low, down + across))
    if held:
        yield held


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark, r = vectors.sparkSession, float(np.sqrt(2 - 2 * cosine))
    v = F.col("embedding")
    given = vectors.schema[vector_col].dataType
    kind = "array<float>" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    sound = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("embedding")
            flat, bounds = x.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0, np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))])
            keys = [hashlib.sha256(flat[i:j].tobytes()).digest() for i, j in pairwise(bounds.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, type=pa.binary()), x], names=["vec_id", "key", "embedding"])

    good = rows.filter(sound).mapInArrow(named, f"vec_id long, key binary, embedding {kind}")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    path = new_folder(spark, "vectors")
    classes = staged(good.groupBy("key", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vectors", path)
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return alone
    sample = hash_sample(classes, SAMPLE, n, "id").select("embedding").toArrow()
    pivots = choose_pivots(_matrix(sample["embedding"], width), n, r)
    between = _distances(pivots, pivots)

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.full(len(pivots), -1.0)
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b.column(0), width), pivots)
                np.maximum.at(out, d.argmin(axis=1), d.min(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["cell", "radius"])

    radius = np.full(len(pivots), -1.0)
    for row in classes.select("embedding").mapInArrow(radii, "cell long, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # a row for each pivot
        radius[row.cell] = row.radius

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(_matrix(b.column("embedding"), width), pivots)
            home = d.argmin(axis=1)
            to = _half(_reached(d, between, np.where(radius < 0, -np.inf, radius), r), home)
            bounds = np.concatenate([[0], np.cumsum(to.sum(axis=1))])
            cells = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(np.nonzero(to)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "id", "n", "embedding")), pa.array(home.astype(np.int32)), cells], names=["key", "id", "n", "embedding", "home", "cells"])

    placed = staged(classes.select("key", "id", "n", "embedding").mapInArrow(assign, f"key binary, id long, n long, embedding {kind}, home int, cells array<int>"), "placed")
    drop_folder(spark, path)
    members = placed.select(F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(True).alias("own"))), F.transform("cells", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own"))))).alias("m"))
    sizes = members.groupBy("m.cell").agg(F.count_if("m.own").alias("own"), F.count_if(~F.col("m.own")).alias("foreign")).orderBy("cell").collect()  # a row for each pivot
    size, deal = _block(n), F.abs(F.xxhash64("id") % (1 << 30))

    def compare(table: pa.Table) -> pa.Table:
        first = table["own"].to_numpy()
        ids, n_of, x = table["id"].to_numpy(), table["n"].to_numpy().astype(np.float64), _matrix(table["embedding"], width)
        same = table["i"][0].as_py() == table["j"][0].as_py()
        a = np.flatnonzero(first)
        b = a if same else np.flatnonzero(~first)
        links, down, up = np.zeros(len(ids)), [], []
        small = x.astype(np.float32)
        across = small[b].T
        for start in range(0, len(a) if len(b) else 0, AT_ONCE):
            some = a[start : start + AT_ONCE]
            # single precision tells which pairs may be linked, double precision which are
            i, j = np.nonzero(small[some] @ across >= cosine - NEAR)
            if len(i) > len(some) * len(b) // 16:
                i, j = np.nonzero(x[some] @ x[b].T >= cosine)
            else:
                linked = np.einsum("ij,ij->i", x[some[i]], x[b[j]]) >= cosine
                i, j = i[linked], j[linked]
            if same:
                i, j = i[i + start != j], j[i + start != j]
            if len(i):
                links[some] += np.bincount(i, n_of[b[j]], len(some))
                if not same:
                    links[b] += np.bincount(j, n_of[some[i]], len(b))
                if len(i) <= len(some):
                    pairs = ids[some[i]], ids[b[j]]
                else:
                    linked = np.zeros((len(some), len(b)), bool)
                    linked[i, j] = True
                    pairs = ties(linked, ids[some], ids[b])
                for out, more in zip((down, up), pairs, strict=True):
                    out.append(more)
        there = np.flatnonzero(links)
        n_ties = sum(map(len, down))
        return pa.table({"a": np.concatenate([ids[there], *down]).astype(np.int64), "b": np.concatenate([np.full(len(there), -1), *up]).astype(np.int64), "links": np.concatenate([links[there], np.full(n_ties, -1)]).astype(np.int64), "tie": np.concatenate([np.zeros(len(there), bool), np.ones(n_ties, bool)])})

    found_at, found = new_folder(spark, "found"), None
    counted = spark.createDataFrame([(s.cell, -(-s.own // size), -(-s.foreign // size)) for s in sizes], "cell int, down long, across long")
    for pieces in rounds([(s.cell, s.own, s.foreign) for s in sizes], size, ROUND * n):
        # a row for each block of a cell at most
        asked = F.broadcast(spark.createDataFrame(pieces, "cell int, i long, low long, high long").join(F.broadcast(counted), "cell"))
        here = F.array(*map(F.lit, sorted({p[0] for p in pieces})))
        own = placed.select("id", "n", "embedding", F.col("home").alias("cell")).join(asked, "cell").withColumn("block", deal % F.col("down"))
        first = own.filter("block = i").select("cell", "i", F.explode(F.sequence("low", F.col("high") - 1)).alias("j"), F.lit(True).alias("own"), "id", "n", "embedding")
        second = own.filter("block <> i and block >= low and block < high").select("cell", "i", F.col("block").alias("j"), F.lit(False).alias("own"), "id", "n", "embedding")
        others = placed.select("id", "n", "embedding", F.explode(F.array_intersect("cells", here)).alias("cell")).join(asked, "cell").withColumn("block", F.col("down") + deal % F.col("across"))
        third = others.filter("block >= low and block < high").select("cell", "i", F.col("block").alias("j"), F.lit(False).alias("own"), "id", "n", "embedding")
        found = staged(first.unionByName(second).unionByName(third).groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long, links long, tie boolean"), "found", found_at)
    degree = found.filter("not tie").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    groups = components(found.filter("tie").select("a", "b"))
    classed = placed.select("key", "id", "n").join(degree, "id", "left").join(groups, "id", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = good.select("vec_id", "key").join(classed, "key").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(alone)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
