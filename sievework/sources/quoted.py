"""Delimited files whose quoted cells hold line feeds, read in many tasks, and the hash of a file of any size.

Spark splits a file into blocks at line feeds.  Whether a line feed is inside a cell depends on all quotes before it, so a
first pass counts the quotes of each block, their running sum tells whether a block begins inside a cell, and a second
pass puts lines together to records.  A record that goes beyond its block is left in parts, one for each block, which
are put together last.  A doubled quote inside a cell counts twice and changes nothing; a quote inside a cell that is
not quoted is not foreseen (see delimited.read_delimited without line feeds).

Nothing is read whole: a task holds one record or the part of it that its block has.  What is broadcast has a row for each
block of the files, which the scan's own plan has too.
"""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.sources.delimited import sniff
from sievework.sources.shared import staged

PARTS = "file string, block long, at long, position long, whole boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, value: the lines of all blocks, each in its order, with a carriage return where the file has one."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of blocks, and parts of those that begin or end elsewhere.  `at` is the block where a record begins, or -1
    where that is a block before this one; position counts the records of a block."""
    here, inside, position, held, begun = None, False, 0, [], False

    def row(file: str, block: int, whole: bool) -> tuple:
        return file, block, block if begun else -1, position, whole, "\n".join(held)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[p.split()[0] for p in PARTS.split(", ")])

    for batch in batches:
        rows = []
        for file, block, value, open_ in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "value", "inside")], strict=True):
            if (file, block) != here:
                if held:
                    rows.append(row(*here, False))
                here, inside, position, held, begun = (file, block), open_, 0, [], not open_
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                if not begun or held not in ([""], ["\r"]):  # an empty line is no record
                    rows.append(row(file, block, begun))
                    position += begun
                held, begun = [], True
        yield batch_of(rows)
    if held:
        yield batch_of([row(*here, False)])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, position (from 0 in its file) and text of every record of the files but empty lines."""
    lines = _lines(spark, path)
    counted = lines.groupBy("file", "block").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("file", "block", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))
    parts = staged(lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "inside").mapInArrow(_records, PARTS), "records")
    # A part that begins in no block here belongs to the last record that begins before it.
    begins = parts.filter("not whole and at >= 0").select("file", "block", "position")
    blocks = parts.groupBy("file", "block").agg(F.count_if(F.col("at") >= 0).alias("n"))
    order = Window.partitionBy("file").orderBy("block")
    first = blocks.select("file", "block", (F.sum("n").over(order) - F.col("n")).alias("first"))
    open_ = first.join(begins, ["file", "block"], "left").select("file", "block", "first", F.last(F.when(F.col("position").isNotNull(), F.col("first") + F.col("position")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    placed = parts.join(F.broadcast(open_), ["file", "block"])
    whole = placed.filter("whole").select("file", (F.col("first") + F.col("position")).alias("position"), "text")
    cut = placed.filter("not whole").select("file", F.when(F.col("at") >= 0, F.col("first") + F.col("position")).otherwise(F.col("open")).alias("position"), "block", "text")
    joined = cut.groupBy("file", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined)


def read_quoted(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, max_rows: int | None = None) -> DataFrame:
    """All cells as text (short rows filled with empty ones, long ones cut) and _row_id from 0 in the order of the files'
    names and their records; of these rows the first max_rows.  Each file's first record names its columns (header), the
    first file's hold for all."""
    d = delimiter or sniff(spark, path)
    found = records(spark, path).withColumn("text", F.regexp_replace("text", r"\r\z", ""))
    per_file = found.groupBy("file").agg(F.count("*").alias("n"))
    top = found.filter("position = 0").orderBy("file").select("text").first()
    if top is None:
        raise ValueError(f"{path}: empty")
    options = {"sep": d, "quote": '"', "escape": '"', "multiLine": "true"}
    cells = next(csv.reader([top.text], delimiter=d))
    n = len(cells)
    names = [c or f"column_{k + 1}" for k, c in enumerate(cells)] if header else [f"column_{k + 1}" for k in range(n)]
    lost = 1 if header else 0
    first = F.coalesce(F.sum(F.col("n") - lost).over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = found.join(F.broadcast(per_file.withColumn("first", first)), "file").filter(F.col("position") >= lost)
    read = numbered.select((F.col("first") + F.col("position") - lost).alias("_row_id"), F.from_csv("text", ", ".join(f"c{k} string" for k in range(n)), options).alias("c"))
    rows = read.select("_row_id", *[F.coalesce(F.col(f"c.c{k}"), F.lit("")).alias(name) for k, name in enumerate(names)])
    return rows if max_rows is None else rows.filter(F.col("_row_id") < max_rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    file, digest, size, total = None, None, 0, 0

    def done() -> tuple:
        if size < total:
            digest.update(b"\n")  # the file ends with a line feed
        return file, "sha256:" + digest.hexdigest(), total

    for batch in batches:
        found = []
        for f, whole, value in zip(*[batch.column(c).to_pylist() for c in ("file", "size", "value")], strict=True):
            if f != file:
                if file is not None:
                    found.append(done())
                file, digest, size, total = f, hashlib.sha256(), 0, whole
            else:
                digest.update(b"\n")
                size += 1
            digest.update(value)
            size += len(value)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.string()), pa.array([r[2] for r in found], pa.int64())], names=["path", "hash", "size"])
    if file is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["path", "hash", "size"])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, hash and size of each file with bytes, as a stream of its lines in order: a digest can only be made by one task a
    file, which holds a batch of lines.  Files without a byte have no line and are left out."""
    lines = spark.read.option("lineSep", "\n").text(path)
    order = F.monotonically_increasing_id()  # rises within a block
    told = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), order.alias("line"), F.col("value").cast("binary").alias("value"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return told.repartition(n, "file").sortWithinPartitions("file", "block", "line").select("file", "size", "value").mapInArrow(_digests, "path string, hash string, size long")
