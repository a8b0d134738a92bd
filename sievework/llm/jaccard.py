"""N-gram Jaccard join over sets of word shingles, exact, for connected components.

1. Viability: a text can link only if at least the threshold's share of its shingles occurs in another text.  Names of
   shingles are dealt over buckets, and the answers (see names) tell each text in how many texts each is; for all texts
   those of the first fragments, in which no more may be missing than in all, then for what is left those of all fragments.
2. The same answers give the global order of shingles, from rare to frequent.  Two texts that link share one of
   the first n - ceil(t n) + 1 (prefix filter).
3. Vertical partitioning: the shingles are cut into fragments by their names; each fragment counts the overlap of its
   part of a pair by itself, and the counts are summed for each pair.
4. Texts that share a prefix shingle are compared with one of them; what links is one component.  Then the texts
   outside of the largest component of a shingle are compared with all others of that shingle: pair by pair where
   they are few, else by blocks, as matrices of partial overlaps that give ties and no pairs.  So a group of near
   copies never makes rows of all its pairs, and no link between components is lost.

Steps 1 and 2 go by names of 64 bits, which can only add candidates; links are decided by names of 128 bits.
Whole copies of a text are one node from the start.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing; fewer words than a
shingle are one shingle; a null id gets no component; rows with one id are always in one component; equal rows give
equal results; a very long text is one task's work, with 16 bytes for each of its shingles; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import hashing as H
from sievework.llm.graph import components, ties
from sievework.llm.names import Told, told_names
from sievework.llm.repeats import MARK, keyed, mark_of, starts_of
from sievework.llm.shared import partitions, split_by, staged, text_bytes, text_slices, without

WORDS, THRESHOLD, FRAGMENTS = 5, 80, 8
#: Fragments by which all texts are judged first; those that can link by them are judged by all fragments.
ASKED = 3
#: Shingles of more texts than SMALL are compared by blocks of at most about BLOCK texts and BLOCK_SHINGLES shingles,
#: by matrices of at most MATRIX_COLUMNS columns; others pair by pair.
SMALL, BLOCK, BLOCK_SHINGLES, MATRIX_COLUMNS = 12, 1024, 1 << 19, 4096


def shingles(data: np.ndarray, bounds: np.ndarray, words: int = WORDS, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the distinct shingles of each text, the text of each (in order), and with wide a second name."""
    data = H.lower_ascii(data)
    starts, ends, of = H.word_bounds(data, bounds)
    size = np.diff(of)
    begin, short = starts_of(of, words), np.flatnonzero((size > 0) & (size < words))

    def names(seed: int) -> np.ndarray:
        single = H.word_prints(data, starts, ends, seed)
        few = [H.sequence_prints(single, of[k : k + 1], int(size[k])) for k in short.tolist()]
        return np.concatenate([H.sequence_prints(single, begin, words), *few])

    prints = names(0)
    owner = np.searchsorted(of, np.concatenate([begin, of[short]]), side="right") - 1
    order = np.lexsort((prints, owner))
    prints, owner = prints[order], owner[order]
    new = np.ones(len(prints), dtype=bool)
    new[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
    return prints[new], owner[new], names(1)[order][new] if wide else prints[:0]


def _fragment(names: np.ndarray, number: int) -> np.ndarray:
    return ((names >> H.U64(32)) * H.U64(number) >> H.U64(32)).astype(np.int64)


def shared_shingles(docs: DataFrame, buckets: int, threshold: int, asked: int = FRAGMENTS) -> DataFrame:
    """Of each text mark, node (its id), n (number of shingles), able (whether it can link, judged by the first `asked`
    fragments), s (how many shingles of these occur in another text) and, if all fragments are asked for, prefix: of the
    s those that come first in the global order, if the text is able."""

    def names_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        first = 0
        for part in text_slices(iter([batch])):
            names, owner, _ = shingles(*text_bytes(part.column("text")))
            some = _fragment(names, FRAGMENTS) < asked
            yield first, names[some], np.bincount(owner[some], minlength=part.num_rows), np.bincount(owner, minlength=part.num_rows)
            first += part.num_rows

    def finish(told: Told) -> pa.RecordBatch:
        n, m, text = told.totals, told.counts, np.repeat(np.arange(len(told.counts)), told.counts)
        shared = told.times > 1
        s, least = np.bincount(text[shared], minlength=len(n)), (threshold * n + 99) // 100
        # all but n - least of its shingles are in a text that it links with
        able = (n > 0) & (m - s <= n - least)
        columns = [pa.array(told.marks, type=pa.binary()), pa.array(told.ids), pa.array(n), pa.array(able), pa.array(s)]
        if asked == FRAGMENTS:
            take = np.where(able, s - least + 1, 0)
            mine = np.flatnonzero(shared & (take[text] > 0))
            order = mine[np.lexsort((told.names[mine], told.times[mine], text[mine]))]
            own = text[order]
            kept = order[np.arange(len(own)) - np.searchsorted(own, own) < take[own]]
            columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[kept], np.arange(len(n) + 1)), type=pa.int32()), pa.array(told.names[kept].astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, names=["mark", "node", "n", "able", "s", "prefix"][: len(columns)])

    schema = "mark binary, node long, n long, able boolean, s long" + ", prefix array<long>" * (asked == FRAGMENTS)
    return told_names(docs, names_of, buckets, finish, schema, keep_names=asked == FRAGMENTS)


def fragments(docs: DataFrame, number: int = FRAGMENTS) -> DataFrame:
    """node, text (tells texts of one node apart), n, fragment, part: the names of a text's shingles by fragment, 16 bytes each."""
    kinds = pa.schema([("node", pa.int64()), ("text", pa.int64()), ("n", pa.int64()), ("fragment", pa.int32()), ("part", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            prints, owner, second = shingles(*text_bytes(batch.column("text")), wide=True)
            if not len(prints):
                continue
            n = np.bincount(owner, minlength=batch.num_rows)
            key = owner * number + _fragment(prints, number)
            order = np.argsort(key, kind="stable")
            head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            both = np.stack([prints[order], second[order]], axis=1)
            limits = pa.py_buffer((16 * np.append(head, len(order))).astype(np.int32).tobytes())
            data = pa.Array.from_buffers(pa.binary(), len(head), [None, limits, pa.py_buffer(both.tobytes())])
            own = key[order][head]
            texts = own // number
            marks = np.array([int.from_bytes(m[:8], "big", signed=True) for m in batch.column("mark").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_numpy()[texts]), pa.array(marks[texts]), pa.array(n[texts]), pa.array((own % number).astype(np.int32)), data], schema=kinds)

    return docs.select("doc_id", "mark", "text").mapInArrow(task, "node long, text long, n long, fragment int, part binary")


def _codes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The part of each shingle, and a number that equal shingles have in common."""
    pairs = np.frombuffer(b"".join(parts), dtype=H.U64).reshape(-1, 2)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (pairs[order[1:]] != pairs[order[:-1]]).any(axis=1)
    code = np.empty(len(order), dtype=np.int64)
    code[order] = np.cumsum(new) - 1
    return np.repeat(np.arange(len(parts)), [len(p) // 16 for p in parts]), code


def verified(pairs: DataFrame, parts: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose Jaccard index is at least threshold percent: the overlap is counted in each fragment and summed."""
    left, right = (parts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"), F.col("n").alias(f"n{x}"), "fragment", F.col("part").alias(f"p{x}")) for x in "ab")
    keys = ["a", "b", "ta", "tb", "na", "nb"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "pa"):
            if batch.num_rows:
                both = [batch.column(c).to_pylist() for c in ("pa", "pb")]
                line, code = _codes(both[0] + both[1])
                # a shingle occurs once on each side of a pair
                key = np.sort(code * batch.num_rows + line % batch.num_rows)
                overlap = np.bincount(key[1:][key[1:] == key[:-1]] % batch.num_rows, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(overlap)], names=[*keys, "overlap"])

    joined = pairs.join(left, "a").join(right, ["b", "fragment"]).select(*keys, "pa", "pb")
    summed = joined.mapInArrow(count, ", ".join(f"{k} long" for k in [*keys, "overlap"])).groupBy(*keys).agg(F.sum("overlap").alias("overlap"))
    return summed.filter(F.expr(f"100 * overlap >= {threshold} * (na + nb - overlap)")).select("a", "b").distinct()


def _near(threshold: int, x: str, y: str) -> str:
    """What sizes (n) and numbers of shared shingles (s) a pair that links can have: its overlap is within both s."""
    return f"{100 + threshold} * least({x}s, {y}s) >= {threshold} * ({x}n + {y}n)"


def _blocks(entries: DataFrame) -> DataFrame:
    """down and across: the number of blocks of each group's outside texts and of all its texts."""
    weight = F.greatest(F.lit(1.0) / BLOCK, F.col("n") / BLOCK_SHINGLES)
    return entries.groupBy("group").agg(F.ceil(F.sum(F.when(F.col("outside"), weight).otherwise(0.0))).cast("long").alias("down"), F.ceil(F.sum(weight)).cast("long").alias("across"), F.count_if("outside").alias("rows"), F.count("*").alias("columns"))


def _deal(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """group, i, j, own, node: every outside text with all blocks across, every text with all blocks down."""
    sized, deal, zero = entries.join(sizes, "group"), F.pmod(F.xxhash64("node"), F.lit(1 << 30)), F.lit(0).cast("long")
    rows = sized.filter("outside").select("group", (deal % F.col("down")).alias("i"), F.explode(F.sequence(zero, F.col("across") - 1)).alias("j"), F.lit(True).alias("own"), "node")
    columns = sized.select("group", F.explode(F.sequence(zero, F.col("down") - 1)).alias("i"), (deal % F.col("across")).alias("j"), F.lit(False).alias("own"), "node")
    return rows.unionByName(columns)


def block_links(open_: DataFrame, parts: DataFrame, threshold: int) -> DataFrame:
    """Ties (a, b) between texts outside of a shingle's largest component and the texts linked with them, by blocks:
    each fragment gives a matrix of partial overlaps, and their sum tells the links.  No pair is a row.

    Texts mostly meet in many shingles.  So the shingles whose texts hang together are compared as one cluster, each
    text once, unless that makes more rows than going through these shingles one by one."""
    outside = F.col("component") != F.col("largest")
    by_gram = open_.select(F.col("gram").alias("group"), "node", "n", outside.alias("outside"))
    least = open_.groupBy("gram").agg(F.min("node").alias("a"))
    clusters = staged(components(open_.join(least, "gram").select("a", F.col("node").alias("b"))).toDF("node", "cluster"), "clusters")
    by_cluster = open_.join(clusters, "node").groupBy("cluster", "node", "n").agg(F.max(outside).alias("outside")).select(F.xxhash64(F.lit("cluster"), "cluster").alias("group"), "node", "n", "outside", "cluster")
    gram_blocks, cluster_blocks = staged(_blocks(by_gram), "blocks"), staged(_blocks(by_cluster), "blocks")
    cost = F.col("rows") * F.col("across") + F.col("columns") * F.col("down")
    of = least.select(F.col("gram").alias("group"), F.col("a").alias("node")).join(clusters, "node").select("group", F.xxhash64(F.lit("cluster"), "cluster").alias("cluster"))
    each = gram_blocks.join(of, "group").groupBy("cluster").agg(F.sum(cost).alias("each")).withColumnRenamed("cluster", "group")
    whole = staged(cluster_blocks.withColumn("cost", cost).join(each, "group").filter("cost <= each").select("group"), "whole")
    single = of.join(whole.withColumnRenamed("group", "cluster"), "cluster", "left_anti").select("group")
    dealt = _deal(by_cluster.drop("cluster"), cluster_blocks.join(whole, "group")).unionByName(_deal(by_gram, gram_blocks.join(single, "group")))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, node, text, n, fragment = (table[c].to_numpy() for c in ("own", "node", "text", "n", "fragment"))
        # a line for each text on either side
        order = np.lexsort((text, node, own))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (own[order[1:]] != own[order[:-1]]) | (node[order[1:]] != node[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
        first = order[new]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        across = int((~own[first]).sum())  # lines that are not its own come first
        b, a, nb, na = *np.split(node[first], [across]), *np.split(n[first], [across])
        total = np.zeros((len(a), len(b)), dtype=np.float32)
        lists = table["part"].to_pylist()
        for f in np.unique(fragment):
            these = np.flatnonzero(fragment == f)
            line, code = _codes([lists[k] for k in these.tolist()])
            line = place[these[line]]
            mine = line >= across
            there = np.zeros((2, int(code.max()) + 1 if len(code) else 0), dtype=bool)
            there[mine.astype(int), code] = True
            both = there.all(axis=0)
            code = np.where(both[code], np.cumsum(both)[code] - 1, -1)
            for start in range(0, int(both.sum()), MATRIX_COLUMNS):
                now = (code >= start) & (code < start + MATRIX_COLUMNS)
                left, right = (np.zeros((len(x), min(MATRIX_COLUMNS, int(both.sum()) - start)), dtype=np.float32) for x in (a, b))
                left[line[now & mine] - across, code[now & mine] - start] = 1
                right[line[now & ~mine], code[now & ~mine] - start] = 1
                total += left @ right.T
        linked = (100 * total >= threshold * (na[:, None] + nb[None, :] - total)) & (a[:, None] != b[None, :])
        down, up = ties(linked, a, b)
        return pa.table({"a": down, "b": up})

    return dealt.join(parts, "node").groupBy("group", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def links(docs: DataFrame, told: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of ids whose components are those of all links.  docs: doc_id (not null), mark, text of what can
    link, without copies; told: node, n, s and prefix of the same."""
    parts = staged(fragments(docs), "fragments")
    prefix = staged(told.select("node", "n", "s", F.explode("prefix").alias("gram")), "prefix")
    # every text is compared with one text of each of its shingles
    centre = prefix.groupBy("gram").agg(F.min_by(F.struct("node", "n", "s"), F.xxhash64("node")).alias("c"), F.count("*").alias("k")).filter("k > 1")
    met = prefix.join(centre, "gram").filter("node != c.node and " + _near(threshold, "", "c."))
    first = staged(met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct(), "pairs")
    found = staged(verified(first, parts, threshold), "links")
    # what is left: texts with a shingle in common that are in different components
    open_ = _open(prefix, found)
    x, y = open_.filter(f"k <= {SMALL} and component != largest").alias("x"), open_.filter(f"k <= {SMALL}").alias("y")
    crossed = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.component") != F.col("y.component")) & F.expr(_near(threshold, "x.", "y.")))
    rest = crossed.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    by_block = block_links(open_.filter(f"k > {SMALL}"), parts, threshold)
    return found.unionByName(verified(staged(rest, "pairs"), parts, threshold)).unionByName(by_block)


def _open(prefix: DataFrame, found: DataFrame) -> DataFrame:
    """gram, node, n, s, component, largest (component) and k (texts) of the shingles whose texts are in several components."""
    placed = prefix.join(components(found).withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("gram", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("gram").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("k").alias("k")).filter("parts > 1").select("gram", "largest", "k")
    return staged(placed.join(largest, "gram"), "open")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and mark (of id and text) of every row."""
    # texts without a word link with nothing, so each is a node of its own
    alone = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), "").otherwise(F.col("doc_id").cast("string")).cast("binary")
    buckets = partitions(docs.sparkSession)
    own = keyed(docs, id_col, text_col).withColumn("print", F.concat(F.unhex(F.sha2("text", 256)), alone))
    known = own.filter("doc_id is not null")
    # nodes: the least id of each text that has words
    classes = known.groupBy("print").agg(F.min(F.struct("doc_id", "mark")).alias("c")).select("print", F.col("c.doc_id").alias("node"), F.col("c.mark").alias("node_mark"))
    classes = staged(classes, "classes")
    nodes = staged(known.select("doc_id", "mark", "print").join(classes, "print").select("doc_id", "mark", "node", "node_mark"), "nodes")
    copies = nodes.filter("mark != node_mark").select("mark")
    firsts = without(known.select("doc_id", "mark", "text"), copies, "mark")
    told = staged(shared_shingles(firsts, buckets, threshold, ASKED).dropDuplicates(["mark"]), "told")
    able = told.filter("able").select("mark")
    perhaps, _ = split_by(firsts, able, "mark")
    candidates = staged(perhaps.join(able, "mark", "left_semi").dropDuplicates(["mark"]), "candidates")
    ranked = staged(shared_shingles(candidates, buckets, threshold), "ranked").filter("able")
    ties = links(candidates.join(ranked.select("mark"), "mark", "left_semi"), ranked, threshold)
    # rows of one id are one node: the least nodes of its texts are tied
    many = nodes.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b or a < doc_id")
    same = nodes.join(many.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).unionByName(many.select(F.col("doc_id").alias("a"), F.col("a").alias("b")))
    labels = components(ties.unionByName(same))
    sized = nodes.dropDuplicates(["mark"]).join(told.select(F.col("mark").alias("node_mark"), "n"), "node_mark", "left")
    done = sized.join(labels.withColumnRenamed("id", "node"), "node", "left").select("mark", F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            n = np.bincount(shingles(*text_bytes(batch.column("text")))[1], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n), pa.nulls(batch.num_rows, pa.int64())], names=["doc_id", "mark", "n_shingles", "component_id"])

    unknown = own.filter("doc_id is null").select("doc_id", "mark", "text")
    alone = unknown.mapInArrow(counted, "doc_id long, mark binary, n_shingles long, component_id long")
    out = known.select("doc_id", "mark").join(done, "mark").unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", "mark")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs (all columns) without those that are not the least id of their component."""
    judged = near_duplicates(docs)
    dropped = staged(judged.filter("component_id != doc_id").select(F.col("mark").alias(MARK)).distinct(), "dropped")
    marked = docs.withColumn(MARK, mark_of(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return without(marked, dropped, MARK).select(*docs.columns)
