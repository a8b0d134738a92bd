"""Helpers that several corpus operators use: staging in the shared folder, bounded batches, id bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once.
SLICE_BYTES = 1 << 19
#: Options of a staged write: Spark deletes the shuffle files of a finished query, and sends a task's Python worker this
#: many texts at once.
_OPTIONS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder to be written, which goes when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder whose rows are needed no more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and the shuffles behind it are freed.  With a path of
    new_folder it is added to what is there, and all of that is read."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    before = {k: spark.conf.get(k, None) for k in _OPTIONS}
    for k, v in _OPTIONS.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(df: DataFrame, rows: int, n: int, *keys: str) -> DataFrame:
    """At most `rows` of the n rows of df, those of the least hash of keys.  A bound on the hash that about four times as
    many pass goes first, so that no task brings forward more than its share of them."""
    order = F.xxhash64(*keys)
    bound = min((1 << 63) - 1, (rows << 66) // max(n, 1) - (1 << 63))
    return df.filter(order <= bound).orderBy(order, *keys).limit(rows)


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most about `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        start = 0
        for end in [*cuts.tolist(), batch.num_rows]:
            yield batch.slice(start, end - start)
            start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values one after another (null: empty), and their bounds."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


#: Bits of a bitmap of marks.  As 64-bit words it has 2**18 rows at most, whatever the input, and is broadcast.
BITMAP_BITS = 1 << 24


def bitmap(marks: DataFrame, column: str) -> DataFrame:
    """word and bits: a fixed-size bitmap of a column of longs, in which a clear bit proves that a value is absent."""
    slot = F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))
    words = marks.select(F.shiftright(slot, 6).alias("word"), slot.alias("slot")).selectExpr("word", "shiftleft(1L, cast(slot & 63 as int)) as bit")
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def split_by(rows: DataFrame, marks: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose mark may be among marks, and rows whose mark surely is not.  Only the first need a join with them,
    so that texts without a partner are not shuffled; where the bitmap is full, all rows are in the first."""
    words = staged(bitmap(marks, column), "bitmap").toDF("__sievework_word", "__sievework_bits")
    slot = F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))
    tested = rows.withColumn("__sievework_word", F.shiftright(slot, 6)).withColumn("__sievework_slot", slot).join(F.broadcast(words), "__sievework_word", "left")
    hit = F.expr("coalesce(shiftright(__sievework_bits, cast(__sievework_slot & 63 as int)) & 1, 0) = 1")
    return tested.filter(hit).select(*rows.columns), tested.filter(~hit).select(*rows.columns)


def without(rows: DataFrame, marks: DataFrame, column: str) -> DataFrame:
    """Rows whose mark is not among marks; those that surely are not are passed on without a shuffle.  What was joined is in
    the order of the column, whatever join was chosen, so that a task that runs again gets its rows as before (a sort
    that a merge join makes anyway is not repeated)."""
    perhaps, surely = split_by(rows, marks, column)
    return surely.unionByName(perhaps.join(marks.select(column), column, "left_anti").select(*rows.columns).sortWithinPartitions(column))
