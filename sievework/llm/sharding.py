"""Sharding by a hierarchical weighted hash tree, with DataFrame functions alone.

A row descends from the root to a region, a rack and a shard.  At each level every child draws a number for the row, an
exponential variable whose rate is the child's weight, made from a hash of the row's key and the child's path; the least
number wins.  A child therefore wins in proportion to its weight, and when a weight changes, a row moves only into or out
of the child whose weight changed: movement stays within the subtrees on the path of the change.

Shards that are added later make a generation of their own, a separate straw at the root for each region they stand in.
A row that this straw wins descends among the new shards only, so that growing takes rows into the new shards and moves
none between old ones.

Slots number the rows of a shard without a gap.  A hash of the key deals them into 4,096 buckets a shard; the counts of
the buckets, of which there are at most 4,096 times the shards however large the table is, give each bucket its first
slot, and the rows of one bucket are numbered by key, size and checksum.

Defined cases: a null key draws as the empty text does, so that all such rows share a shard; rows of one key always share
a shard; repeated rows get slots one after another; null text is empty (size 1, checksum 0); texts may be of any length,
only their size and checksum go on; equal texts are told apart by their keys and spread as any others do; ties of a draw,
which only equal hashes make, go to the smaller path; an empty table gives no rows; other columns are not read by the
query, and `assigned` keeps them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a draw (52 bits, exact as a double) and of a bucket of slots.
DRAW_DIGITS, BUCKET_DIGITS = 13, 3


class Shard(NamedTuple):
    """A leaf of the tree.  `since` is the generation in which it was added."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0
    since: int = 0


#: Shards 0 to 7 in two regions of two racks, and a ninth that is added to the second region.
EIGHT = [Shard(f"r{k // 4}", f"k{k // 2 % 2}", k) for k in range(8)]
NINTH = Shard("r1", "k2", 8, since=1)


def tree(shards: list[Shard]) -> dict[str, list[tuple[str, float, int]]]:
    """Of each inner path its children: path, weight (the sum of the shards below) and shard (the last level; else -1)."""
    weights: dict[str, dict[str, list]] = {}
    for s in shards:
        if s.weight <= 0:
            continue
        top = f"{s.since}/{s.region}"
        for parent, child, leaf in (("", top, -1), (top, f"{top}/{s.rack}", -1), (f"{top}/{s.rack}", f"{top}/{s.rack}/{s.shard}", s.shard)):
            weights.setdefault(parent, {}).setdefault(child, [0.0, leaf])[0] += s.weight
    return {parent: [(path, w, leaf) for path, (w, leaf) in sorted(children.items())] for parent, children in weights.items()}


def _number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential variable of this rate: a hash gives a number strictly between 0 and 1, its logarithm the draw."""
    part = (_number(F.md5(F.concat(key, F.lit("/"), path)), DRAW_DIGITS) + 0.5) / F.lit(float(16**DRAW_DIGITS))
    return -F.log(part) / weight


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The shard of a key: three draws among the children of the node reached so far."""
    children = tree(shards)
    if not children:
        raise ValueError("no shard has a weight above zero")
    node = lambda path, weight, shard: F.struct(F.lit(path).alias("path"), F.lit(weight).alias("weight"), F.lit(shard).alias("shard"))
    by_path = F.create_map(*[x for parent, below in children.items() for x in (F.lit(parent), F.array(*[node(*c) for c in below]))])
    key = F.coalesce(key.cast("string"), F.lit(""))

    def descend(at: Column, _: Column) -> Column:
        draws = F.transform(F.element_at(by_path, at["path"]), lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), c["path"].alias("path"), c["shard"].alias("shard")))
        won = F.array_min(draws)
        return F.struct(won["path"].alias("path"), won["shard"].alias("shard"))

    levels = F.array(F.lit(0), F.lit(1), F.lit(2))
    return F.aggregate(levels, F.struct(F.lit("").alias("path"), F.lit(-1).alias("shard")), descend, lambda at: at["shard"])


def assigned(docs: DataFrame, shards: list[Shard], key: str = "doc_id", to: str = "shard") -> DataFrame:
    """docs with the shard of each row in column `to`; no row is moved to find it."""
    return docs.withColumn(to, shard_of(F.col(f"`{key}`"), shards))


def slots(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows (with columns key, shard and those of `order`) with slot, gapless from 0 in each shard."""
    bucketed = rows.withColumn("__bucket", F.substring(F.md5(F.concat(F.lit("slot/"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, BUCKET_DIGITS))
    sizes = bucketed.groupBy("shard", "__bucket").count()
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(key, *order))
    numbered = bucketed.withColumn("__within", within)
    # At most 4,096 buckets a shard, whatever the table holds; a left join, as an inner one would draw every row anew in a filter.
    return numbered.join(F.broadcast(first), ["shard", "__bucket"], "left").withColumn("slot", F.col("__first") + F.col("__within") - 1).drop("__bucket", "__first", "__within")


def write_shards(docs: DataFrame, shards: list[Shard], path: str, key: str = "doc_id") -> None:
    """docs written as one folder for each shard; every task writes its own rows, so none is moved first."""
    assigned(docs, shards, key, "__shard").withColumnRenamed("__shard", "shard_folder").write.partitionBy("shard_folder").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assigned(assigned(docs, EIGHT), [*EIGHT, NINTH], to="grown_shard")
    return slots(placed, "doc_id", "size", "text_crc32").withColumn("law", F.lit("key"))
