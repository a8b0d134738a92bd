"""The nearest names of a large dictionary within some edits: tries of names walked with a Levenshtein automaton.

Names are dealt into blocks of about BLOCK by their first characters, so that a block is a stretch of the dictionary; names
that share these characters beyond a block's size spread over several by a hash.  A task builds a trie of one block, whose
edges hold texts, and walks it for one text after another.  The automaton's state is a row of distances to the starts of
the text; a branch ends as soon as none of them is within the best distance so far.  As a block holds few beginnings, a
text that begins otherwise leaves it after a few characters.  Every text visits all blocks, as edits may be anywhere: the
rows dealt are texts times blocks, and the number of blocks follows the dictionary alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of one trie, and first characters that a block is chosen by.
BLOCK, FIRST = 50_000, 3

Trie = tuple[str, str | None, list]


def build(names: list[tuple[str, str]], low: int = 0, high: int | None = None, depth: int = 0) -> Trie:
    """The trie of sorted (key, name) with distinct keys: the text of its edge, the name that ends there, its children."""
    high = len(names) if high is None else high
    first, last = names[low][0], names[high - 1][0]
    end = depth
    while end < min(len(first), len(last)) and first[end] == last[end]:
        end += 1
    name = names[low][1] if len(first) == end else None
    start, children = low + (name is not None), []
    while start < high:
        stop = start + 1
        while stop < high and names[stop][0][end] == names[start][0][end]:
            stop += 1
        children.append(build(names, start, stop, end))
        start = stop
    return first[depth:end], name, children


def nearest_in(trie: Trie, text: str, edits: int) -> tuple[int, str] | None:
    """(edits, name) of the nearest name within some edits, the least name of equals."""
    best: list = [edits + 1, None]
    n = len(text)

    def walk(node: Trie, row: list[int], depth: int) -> None:
        label, name, children = node
        for letter in label:
            depth += 1
            limit = min(best[0], edits)
            # Cells further than the limit from the diagonal can't matter; they count as beyond it.
            low, high = max(1, depth - limit), min(n, depth + limit)
            new = [edits + 1] * (n + 1)
            if depth <= limit:
                new[0] = depth
            for j in range(low, high + 1):
                new[j] = min(row[j - 1] + (text[j - 1] != letter), row[j] + 1, new[j - 1] + 1)
            row = new
            if min(row[max(0, depth - limit) : high + 1], default=edits + 1) > limit:
                return
        if name is not None and row[n] <= edits and (row[n] < best[0] or row[n] == best[0] and (best[1] is None or name < best[1])):
            best[:] = row[n], name
        for child in children:
            walk(child, row, depth)

    walk(trie, [j if j <= edits else edits + 1 for j in range(n + 1)], 0)
    return None if best[1] is None else (best[0], best[1])


def _blocks(edits: int):
    """Names of a block (kind 0) come before the texts that look for them (kind 1)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, trie = None, [], None
        for batch in batches:
            found = []
            for at, kind, key, name in zip(*[batch.column(c).to_pylist() for c in ("block", "kind", "key", "name")], strict=True):
                if at != block:
                    block, names, trie = at, [], None
                if kind == 0:
                    names.append((key, name))
                elif names:
                    trie = trie or build(sorted(names))
                    if (best := nearest_in(trie, key, edits)) is not None:
                        found.append((key, best[1], best[0]))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32())], names=["key", "name", "edits"])

    return task


def nearest_names(texts: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """key, name and edits: of each distinct key (a text in small letters) the nearest name of the dictionary within some
    edits, in small letters too, and of equally near ones the least.  Texts without such a name are left out."""
    spark = texts.sparkSession
    keyed = dictionary.filter("name is not null").groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).withColumn("start", F.substring("key", 1, FIRST))
    sizes = keyed.groupBy("start").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A start has its first block, and more of them if it has more names than one block holds.
    placed = sizes.select("start", F.floor(before / BLOCK).alias("first"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    spread = F.col("first") + F.pmod(F.xxhash64("key"), F.col("blocks"))
    named = keyed.join(placed, "start").select(spread.alias("block"), F.lit(0).alias("kind"), "key", "name")
    last = placed.agg(F.max(F.col("first") + F.col("blocks") - 1)).first()[0]
    if last is None:
        return texts.select("key", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("edits")).filter("false")
    asked = texts.select("key").filter("key is not null").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"), F.lit(1).alias("kind"), "key", F.lit(None).cast("string").alias("name"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(last) + 1)
    found = named.unionByName(asked).repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(_blocks(edits), "key string, name string, edits int")
    return found.groupBy("key").agg(F.min_by(F.struct("name", "edits"), F.struct("edits", "name")).alias("b")).select("key", "b.name", "b.edits")
