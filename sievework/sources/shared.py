"""A new folder that driver and executors share, and tasks whose size does not follow the input."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows of a table that a task groups at most about; bytes of a file that it reads.
TASK_ROWS, TASK_BYTES = 1 << 18, 16 << 20


def parts(rows: int) -> int:
    """How many tasks work on so many rows at least."""
    return -(-rows // TASK_ROWS)


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside is cut by rows: more rows make more tasks, not larger ones; shuffles go with their query."""
    own = {
        "spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts(rows))),
        "spark.sql.files.maxPartitionBytes": str(TASK_BYTES),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder to be written under spark.checkpoint.dir (where that is unset and Spark is local, a temporary one), which goes
    when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read from there: what several steps read is made once, and lineage ends."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
