"""A trie of conversations that share their first turns, by an external mergesort that knows longest common prefixes.

A turn goes on as the SHA-256 of its role and text and as the size of its text; texts leave at the scan.  A conversation
is the sequence of its turns, and any order of turns makes conversations that share a prefix neighbours.

1. Tasks gather conversations, sort a bounded number of turns at a time into runs, and write each conversation of a run
   with its LCP, the number of turns that it shares with the one before it.
2. Conversations are dealt by ranges of (turns, conv_id), so that many equal conversations spread over many tasks.  Each
   task merges its pieces of the runs by a tree of losers.  A candidate's LCP with the last winner decides most matches:
   the larger one wins, and only equal ones compare turns, from there on.
3. The merged stream keeps the open path, from the root to the last conversation, on a stack.  A node ends as soon as a
   conversation leaves it; it then gives its counts to its parent.

All counts of a node are sums over the conversations below it, if each node is born at one conversation (the first that
has it) and each leaf is counted at one (the last of its members).  Only nodes open at the first or last conversation of
a task's range can have members in two ranges: their parts are summed by key (the SHA-256 of the path), and where two
ranges meet, the births and leaves that both count are taken off once.  A task gives the parents' numbers to nodes that
ended within its range; the children of shared nodes look theirs up by range and depth.

Memory: a task holds the turns of its range (about RANGE_TURNS, 40 bytes each) or one conversation, whichever is larger.
The ids of conversations that end at a shared node go on in texts of CHUNK ids; one task then hashes them as a stream, as a
SHA-256 can only be made in order.

Defined cases: rows whose conv_id is null belong to no conversation; null role or text is empty; turns go by number (null
first) and, where numbers tie, by the SHA-256 of role and text; repeated rows are turns of their own; a conversation may
be without turns after it is rebuilt and is then a member of the root alone; an empty table gives no node, not even a
root; texts of any length cost the same after the scan; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.shared import partitions, staged

#: Turns of a run, and turns of a range (on average) that one task merges.
RUN_TURNS, RANGE_TURNS = 1 << 16, 1 << 19
#: Ids in one text of ids on the way to a hash, and nodes in one batch that a task gives out.
CHUNK, BATCH = 4096, 4096
#: The longest prefix that a conversation takes over from the base of its group.
LONGEST_HEAD = 8
ROOT = hashlib.sha256(b"").digest()

Turns = list[bytes]

RUNS = "run string, seq int, conv_id long, lcp int, names array<binary>, sizes array<long>"
PARTS = (
    "kind string, part int, key binary, depth int, parent_key binary, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, total long, once long, ends string, path int, up int, keys array<binary>, sizes array<long>, last_keys array<binary>"
)


def head_of(conv_id: int) -> int:
    """How many turns a conversation takes over from the base of its group."""
    return zlib.crc32(str(conv_id).encode()) % (LONGEST_HEAD + 1)


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def _long(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, name and size of every turn of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.sha2(F.concat(_long(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), name.alias("name"), _long(text).alias("size"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Turns, list[int]]]:
    """(base, conv_id, names, sizes) of consecutive rows of one conversation."""
    last, names, sizes = None, [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("base", "conv_id", "name", "size")]
        for base, conv, name, size in zip(*columns, strict=True):
            if (base, conv) != last:
                if last is not None:
                    yield *last, names, sizes
                last, names, sizes = (base, conv), [], []
            names.append(name)
            sizes.append(size)
    if last is not None:
        yield *last, names, sizes


def rebuilt(found: Iterator[tuple[int, int, Turns, list[int]]]) -> Iterator[tuple[int, Turns, list[int]]]:
    """Conversations with the first turns of their base, which comes first of its group, put before their own."""
    of, names0, sizes0 = None, [], []
    for base, conv, names, sizes in found:
        if base != of:
            of, names0, sizes0 = (base, names[:LONGEST_HEAD], sizes[:LONGEST_HEAD]) if conv == base else (base, [], [])
        h = head_of(conv)
        yield conv, names0[:h] + names[h:], sizes0[:h] + sizes[h:]


def common(a: Turns, b: Turns, start: int = 0) -> int:
    """How many turns a and b share from the first on, if they share `start`."""
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


def _runs(whole: Callable) -> Callable:
    """Sorted runs of the conversations of a partition, each with its LCP."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def run() -> pa.RecordBatch:
            held.sort(key=lambda c: (c[1], c[0]))
            lcps = [0, *(common(held[k][1], held[k + 1][1]) for k in range(len(held) - 1))]
            columns = [[f"{part}.{number}"] * len(held), list(range(len(held))), [c[0] for c in held], lcps, [c[1] for c in held], [c[2] for c in held]]
            types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in RUNS.split(", ")])

        for c in whole(_conversations(batches)):
            held.append(c)
            turns += len(c[1]) + 1
            if turns >= RUN_TURNS:
                yield run()
                number, turns = number + 1, 0
                held.clear()
        if held:
            yield run()

    return task


class Item(NamedTuple):
    conv_id: int
    names: Turns
    sizes: list[int]


class Losers:
    """A tree of losers over runs.  Every loser keeps its LCP with the winner that beat it, which is the last winner of all
    on the path that the next item of that winner's run climbs."""

    def __init__(self, runs: list[list[tuple[int, Item]]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.lcp = [0] * self.size
        self.tree = [-1] * self.size
        self.winner = self._play(1)

    def _head(self, run: int) -> Item | None:
        return self.runs[run][self.at[run]][1] if run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        won, lost = self._match(self._play(2 * node), self._play(2 * node + 1))
        self.tree[node] = lost
        return won

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; lcp holds what each shares with the last winner, and then, for the loser, with this one."""
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = self.lcp[a], self.lcp[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common(x.names, y.names, p)
        less = len(x.names) < len(y.names) or (len(x.names) == len(y.names) and x.conv_id <= y.conv_id) if n == min(len(x.names), len(y.names)) else x.names[n] < y.names[n]
        won, lost = (a, b) if less else (b, a)
        self.lcp[lost] = n
        return won, lost

    def __iter__(self) -> Iterator[tuple[int, Item]]:
        """(LCP with the item before, item) in order."""
        while (item := self._head(self.winner)) is not None:
            won = self.winner
            yield self.lcp[won], item
            self.at[won] += 1
            if self.at[won] < len(self.runs[won]):
                self.lcp[won] = self.runs[won][self.at[won]][0]
            node = (won + self.size) // 2
            while node:
                won, self.tree[node] = self._match(won, self.tree[node])
                node //= 2
            self.winner = won


class Node:
    """An open or ended node of a range."""

    __slots__ = ("depth", "key", "parent", "size", "conv_id", "n_convs", "n_children", "n_leaves", "total", "once", "ends", "digest", "first")

    def __init__(self, depth: int, key: bytes, parent: Node | None, size: int, first: bool) -> None:
        self.depth, self.key, self.parent, self.size, self.first = depth, key, parent, size, first
        self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.total, self.once = None, 0, 0, 0, 0, size
        self.ends: list[int] | None = [] if first else None
        self.digest = None

    def end_here(self, conv_id: int) -> None:
        if self.ends is None:
            self.ends = []
        self.ends.append(conv_id)

    def close(self) -> None:
        """Give the counts to the parent."""
        self.total += self.n_convs * self.size
        if (above := self.parent) is not None:
            above.n_convs += self.n_convs
            above.conv_id = self.conv_id if above.conv_id is None else min(above.conv_id, self.conv_id)
            above.n_children += 1
            above.n_leaves += self.n_leaves
            above.total += self.total
            above.once += self.once


def nodes_of(merged: Iterator[tuple[int, Item]]) -> tuple[list[Node], list[Node], Item | None, Item | None]:
    """The nodes of a merged range: those that ended before its last conversation, those open at it, and the first and last
    conversation.  A leaf is counted at the last of its members, a node at the first."""
    ended: list[Node] = []
    stack = [Node(0, ROOT, None, 0, True)]
    first = last = None
    for lcp, item in merged:
        if last is not None and lcp < len(last.names):
            stack[-1].n_leaves += 1
        while len(stack) > lcp + 1:
            node = stack.pop()
            node.close()
            ended.append(node)
        for d in range(lcp, len(item.names)):
            above = stack[-1]
            stack.append(Node(d + 1, hashlib.sha256(above.key + item.names[d]).digest(), above, item.sizes[d], first is None))
        top = stack[-1]
        top.n_convs += 1
        top.conv_id = item.conv_id if top.conv_id is None else min(top.conv_id, item.conv_id)
        top.end_here(item.conv_id)
        first, last = first or item, item
    if last is not None:
        stack[-1].n_leaves += 1
        for node in reversed(stack[1:]):
            node.close()
    return ended, stack, first, last


def _rows(kind: str, part: int, **columns: list) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    n = len(next(iter(columns.values())))
    columns |= {"kind": [kind] * n, "part": [part] * n}
    fields = [f.split() for f in PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), types[kind_]) for name, kind_ in fields], names=[name for name, _ in fields])


def _given(nodes: list[Node], part: int, kind: str, shared: set[int], slot: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(nodes), BATCH):
        some = nodes[at : at + BATCH]
        columns = {c: [getattr(n, c) for n in some] for c in ("key", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "total", "once")}
        columns["parent_key"] = [n.parent.key if n.parent else None for n in some]
        columns["parent_conv_id"] = [n.parent.conv_id if n.parent else None for n in some]
        columns["up"] = [slot[id(n.parent)] if n.parent is not None and id(n.parent) in shared else None for n in some]
        columns["path"] = [slot.get(id(n)) for n in some]
        if kind == "node":
            columns["ends"] = [hashlib.sha256(",".join(map(str, n.ends or ())).encode()).hexdigest() for n in some]
        yield _rows(kind, part, **columns)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a range ("node" where all members are in it, "open" where others may be elsewhere), the paths to its first
    and last conversation ("range"), and the ids of conversations that end at open nodes ("ends")."""
    runs: dict[str, list[tuple[int, Item]]] = {}
    reach: dict[str, int] = {}
    for batch in batches:
        for r in zip(*[batch.column(c).to_pylist() for c in ("run", "conv_id", "lcp", "names", "sizes", "seq")], strict=True):
            held = runs.setdefault(r[0], [])
            # A piece of a run is a stretch of it, so its LCPs hold; the first shares nothing with a winner yet.
            assert not held or r[5] == reach[r[0]] + 1
            reach[r[0]] = r[5]
            held.append((r[2] if held else 0, Item(r[1], r[3], r[4])))
    if not runs:
        return
    part = TaskContext.get().partitionId()
    ended, stack, first, last = nodes_of(iter(Losers([runs[k] for k in sorted(runs)])))
    # Of the nodes that ended, those on the path to the first conversation may have members in the range before.
    opened = [n for n in ended if n.first] + stack
    shared = {id(n) for n in opened}
    slot = {id(n): k for k, n in enumerate(opened)}
    yield from _given([n for n in ended if not n.first], part, "node", shared, slot)
    yield from _given(opened, part, "open", shared, slot)
    head, size = [ROOT], []
    for name, n in zip(first.names, first.sizes, strict=True):
        head.append(hashlib.sha256(head[-1] + name).digest())
        size.append(n)
    yield _rows("range", part, conv_id=[first.conv_id], keys=[head], sizes=[size], last_keys=[[n.key for n in stack]])
    for n in opened:
        ids = n.ends or []
        for at in range(0, len(ids), CHUNK):
            yield _rows("ends", part, key=[n.key], conv_id=[ids[at]], ends=[",".join(map(str, ids[at : at + CHUNK]))])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and SHA-256 of the ids of each key, whose texts come in order."""
    key, digest = None, None
    for batch in batches:
        found = []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    found.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
                digest.update(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def _corrections(ranges: DataFrame) -> DataFrame:
    """key, n_children, n_leaves and once to be added where a range and the one before it share a path."""
    pairs = ranges.select(F.col("part").alias("a"), "last_keys").join(ranges.select("part", "before", "keys", "sizes"), F.col("a") == F.col("before"))
    differs = F.array_position(F.transform(F.arrays_zip(F.slice("keys", 1, F.least(F.size("keys"), F.size("last_keys"))).alias("x"), F.slice("last_keys", 1, F.least(F.size("keys"), F.size("last_keys"))).alias("y")), lambda z: z["x"] != z["y"]), True)
    same = F.when(differs > 0, differs - 1).otherwise(F.least(F.size("keys"), F.size("last_keys"))).cast("int")
    held = pairs.withColumn("same", same).select("keys", "sizes", "last_keys", "same", F.explode(F.sequence(F.lit(0), F.col("same") - 1)).alias("d"))
    twice = F.aggregate(F.slice("sizes", F.greatest(F.col("d"), F.lit(1)), F.col("same") - F.greatest(F.col("d"), F.lit(1))), F.lit(0).cast("long"), lambda s, x: s + x)
    return held.select(
        F.col("keys")[F.col("d")].alias("key"),
        F.when(F.col("d") < F.col("same") - 1, -1).otherwise(0).cast("long").alias("n_children"),
        F.when(F.col("same") == F.size("last_keys"), -1).otherwise(0).cast("long").alias("n_leaves"),
        (-twice).alias("once"),
    )


def prefix_trie(conversations: DataFrame, whole: Callable = rebuilt) -> DataFrame:
    """The nodes of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `whole` turns (base, conv_id, names, sizes), group by group and each base first, into the conversations to be placed.
    """
    spark = conversations.sparkSession
    turns = turns_of(conversations).withColumn("base", base_of(F.col("conv_id")))
    own = F.col("conv_id") != F.col("base")
    gathered = turns.repartition(partitions(spark), "base").sortWithinPartitions("base", own, "conv_id", F.col("turn").asc_nulls_first(), "name").select("base", "conv_id", "name", "size")
    runs = staged(gathered.mapInArrow(_runs(whole), RUNS), "runs")
    n = runs.agg(F.sum(F.size("names") + 1)).first()[0] or 0
    ranges = max(partitions(spark), n // RANGE_TURNS + 1)
    parts = staged(runs.repartitionByRange(ranges, "names", "conv_id").sortWithinPartitions("run", "seq").mapInArrow(_merge, PARTS), "nodes")

    # One row for each range: which range comes before it, by the order of their numbers.
    numbered = parts.filter("kind = 'range'").select("part", "keys", "sizes", "last_keys")
    before = numbered.select("part").alias("x").groupBy().agg(F.array_sort(F.collect_list("part")).alias("all"))
    pairs = before.select(F.explode(F.arrays_zip(F.col("all").alias("part"), F.concat(F.array(F.lit(None).cast("int")), F.expr("slice(all, 1, greatest(size(all) - 1, 0))")).alias("before"))).alias("p")).select("p.part", "p.before")
    fixes = _corrections(numbered.join(pairs, "part"))

    opened = parts.filter("kind = 'open'")
    sums = ("n_convs", "n_children", "n_leaves", "total", "once")
    fixed = opened.select("key", "depth", "parent_key", "conv_id", *sums).unionByName(fixes, allowMissingColumns=True)
    hashed = parts.filter("kind = 'ends'").select("key", "conv_id", "ends").repartition(partitions(spark), "key").sortWithinPartitions("key", "conv_id").select("key", "ends").mapInArrow(_streamed, "key binary, ends_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    summed = fixed.groupBy("key").agg(F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums])
    totals = staged(summed.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)), "shared")

    above = totals.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    saved = (F.col("total") - F.col("once")).alias("saved_tokens")
    out = (F.col("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv_id"), F.col("n_convs"), F.col("n_children"), F.col("n_leaves"), saved, F.col("ends_sha256"))
    top = totals.join(above, "parent_key", "left").select(*out)
    # Children of shared nodes find their parent by range and place, never by the parent alone, of which one may have most nodes.
    place = opened.select("part", F.col("path").alias("up"), "key").join(totals.select("key", F.col("conv_id").alias("up_conv_id")), "key").select("part", "up", "up_conv_id")
    nodes = parts.filter("kind = 'node'").withColumnRenamed("ends", "ends_sha256")
    inner = nodes.filter("up is null").select(*out)
    under = nodes.filter("up is not null").drop("parent_conv_id").join(place.withColumnRenamed("up_conv_id", "parent_conv_id"), ["part", "up"]).select(*out)
    return inner.unionByName(under).unionByName(top)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
