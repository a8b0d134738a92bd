"""Audit of how far the sources of a language diverge in their words, by joint histograms of counts.

Terms are counted by language and source.  For a pair of sources only how many terms have a given pair of counts matters:
the joint histogram.  It is tallied over terms that both sources have; the other cells are implied.  With h(a) terms that
one source has a times, m(a, b) terms with both counts and V terms in all, the cell (a, 0) holds h(a) minus the sum of
m(a, .), and (0, 0) the rest of V.  f is therefore evaluated once for each pair of counts, not for each term:

    sum f = sum m(a, b) (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))
          + sum h(a) (f(a, 0) - f(0, 0)) + sum h'(b) (f(0, b) - f(0, 0)) + V f(0, 0)

f is symmetric, so a pair is tallied once and given to both sources.

Scale: tasks count words of 0.5 MB of text at a time and hold HELD terms at most before they pass them on, so that the one
shuffle by (language, term) gets sums.  The counts of a term then lie in one row, one entry a source; tasks tally pairs of
sources over a block of such rows and pass on one row for each pair and pair of counts.  No group of documents, no source
and no language meets in one task; ten terms a source are chosen with partial limits.

Defined cases: null text, lang and source are empty; an empty text has no terms, but its group is reported; every row is a
document of its own, repeated ones too; doc_id is not read; texts of any length are cut at ends of terms into pieces of
PIECE bytes; equal values rank by item in UTF-8 order; a language without kept terms (V = 0) has pairs of value 0 and no
terms; a language with one source has no pairs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.shared import partitions, staged, text_slices

#: Documents of a language that a kept term is in; terms that are ranked for a group; the scale of p.
LEAST_DOCUMENTS, TERMS, SCALE = 10, 10, 1_000_000_000
#: Bytes of a text that are split at once, sums that a task of counting holds, and cells of a block of counts.
PIECE, HELD, CELLS = 1 << 20, 200_000, 1 << 20
#: Bytes of terms to themselves, A-Z to lower case, all others to a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"
TALLY = "lang string, source string, other string, a long, b long, m long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in pieces; a term is never cut."""
    start = 0
    while start < len(text):
        end = start + PIECE
        piece = text[start:end].translate(_TERM)
        while end < len(text) and not piece.endswith(b" "):
            more = text[end : end + 4096].translate(_TERM)
            cut = more.find(b" ") + 1 or len(more)
            piece, end = piece + more[:cut], end + cut
        yield piece.split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)

    def sums() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            terms, has = list(counts), docs[lang, source]
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([counts[t] for t in some], pa.int64()), pa.array([has[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in COUNTS.split(", ")])
        n.clear()
        docs.clear()

    for batch in text_slices(batches):
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            counts, seen = n[lang, source], set()
            for terms in terms_of(text.as_py()):
                counts.update(terms)
                seen.update(terms)
            docs[lang, source].update(seen)
        if sum(map(len, n.values())) >= HELD:
            yield from sums()
    yield from sums()


def kept_terms(docs: DataFrame) -> DataFrame:
    """lang, term, n (in the language) and groups (source and n each) of every kept term; docs has lang, source, text, not null."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count, COUNTS).repartition(partitions(docs.sparkSession), "lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("groups"))
    return by_term.filter(F.col("docs") >= LEAST_DOCUMENTS).select("lang", "term", "n", "groups")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joint histograms of the pairs of sources over blocks of terms of one language."""
    blocks: dict[str, list[list[dict]]] = defaultdict(list)
    entries: Counter = Counter()

    def block(lang: str) -> Iterator[pa.RecordBatch]:
        rows = blocks.pop(lang)
        del entries[lang]
        names = sorted({g["source"] for row in rows for g in row}, key=str.encode)
        at = {s: k for k, s in enumerate(names)}
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.array([at[g["source"]] for r in rows for g in r])
        levels, code = np.unique(np.array([g["n"] for r in rows for g in r], dtype=np.int64), return_inverse=True)
        order = np.lexsort((row, col))
        row, col, code = row[order], col[order], code[order] + 1
        first = np.searchsorted(col, np.arange(len(names) + 1))
        width = len(levels) + 1
        for s in range(len(names) - 1):
            # Counts of source s by term; later sources look theirs up there.
            mine = np.zeros(len(rows), dtype=np.int64)
            mine[row[first[s] : first[s + 1]]] = code[first[s] : first[s + 1]]
            rest = slice(first[s + 1], None)
            both = mine[row[rest]] > 0
            cell = (col[rest][both].astype(np.int64) * width + mine[row[rest]][both]) * width + code[rest][both]
            cells, m = np.unique(cell, return_counts=True)
            if len(cells):
                t, a, b = cells // (width * width), cells // width % width, cells % width
                columns = [pa.array([lang] * len(cells), pa.string()), pa.array([names[s]] * len(cells), pa.string()), pa.array([names[k] for k in t.tolist()], pa.string()), pa.array(levels[a - 1]), pa.array(levels[b - 1]), pa.array(m.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in TALLY.split(", ")])

    for batch in batches:
        for lang, groups in zip(batch.column("lang").to_pylist(), batch.column("groups").to_pylist(), strict=True):
            blocks[lang].append(groups)
            entries[lang] += len(groups)
            if entries[lang] >= CELLS:
                yield from block(lang)
    for lang in list(blocks):
        yield from block(lang)


def p_of(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 v)), exact."""
    whole = F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * v).cast("decimal(20,0)"))
    return 1 + whole


def f_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank of every pair of sources and of the terms that a source has too often."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    plain = docs.select(*text.values())
    kept = staged(kept_terms(plain), "terms")
    groups = kept.select("lang", F.explode("groups").alias("g")).select("lang", "g.source", "g.n")
    histogram = groups.groupBy("lang", "source", "n").agg(F.count("*").alias("h"))
    with_terms = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("h")).alias("total"), F.collect_list(F.struct("n", "h")).alias("counts"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    every = docs.select(text["lang"], text["source"]).distinct().join(with_terms, ["lang", "source"], "left").join(langs, "lang", "left")
    none = F.expr("cast(array() as array<struct<n:bigint,h:bigint>>)")
    sizes = staged(every.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("counts", none).alias("counts")), "sizes")

    totals = sizes.select("lang", "source", "total", "v")
    others = totals.drop("v").withColumnsRenamed({"source": "other", "total": "other_total"})
    total, v = F.col("total"), F.col("v")
    p = lambda count: p_of(count, total, v)
    q = lambda count: p_of(count, F.col("other_total"), v)
    zero = F.lit(0)

    tally = kept.filter(F.size("groups") > 1).select("lang", "groups").mapInArrow(_tally, TALLY).groupBy("lang", "source", "other", "a", "b").agg(F.sum("m").alias("m"))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    gain = m * (f_of(p(a), q(b)) - f_of(p(a), q(zero)) - f_of(p(zero), q(b)) + f_of(p(zero), q(zero)))
    joint = tally.join(totals, ["lang", "source"]).join(others, ["lang", "other"]).groupBy("lang", "source", "other").agg(F.sum(gain).alias("joint"))

    # Every pair of sources of a language is a row of the result; counts are arrays with an entry for each distinct count.
    later = sizes.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"), F.col("counts").alias("other_counts"))
    pairs = sizes.select("lang", "source", "total", "v", "counts").join(later, "lang").filter(F.col("source") < F.col("other"))
    neither = f_of(p(zero), q(zero))
    one = lambda counts, f: F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x["h"] * (f(x["n"]) - neither))
    implied = one("counts", lambda n: f_of(p(n), q(zero))) + one("other_counts", lambda n: f_of(p(zero), q(n))) + v * neither
    alone = pairs.select("lang", "source", "other", F.when(v > 0, implied).otherwise(0).alias("alone"))
    valued = alone.join(joint, ["lang", "source", "other"], "left").select("lang", "source", "other", (F.col("alone") + F.coalesce("joint", F.lit(0))).alias("value"))
    both = valued.select("lang", F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    more = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("groups").alias("g")).select("lang", "g.source", "g.n", "term", "lang_n").join(sizes.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    compared = more.select("lang", "source", "term", p(F.col("n")).alias("p"), p_of(F.col("lang_n"), F.col("lang_total"), v).alias("q")).filter("p > q")
    terms = compared.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f_of(F.col("p"), F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= TERMS))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))
