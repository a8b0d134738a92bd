"""Decisions as a log of events in a shared folder: nothing is written over, and writers don't wait for each other.

Every write is a folder of its own with one file, which Spark's commit moves to its place at once, so that readers see all
events of a write or none, and two writers at the same time both keep theirs.  Replaying takes the last event of each
observation, by time, then by the name of its write.  A standardization that was modified has its mapping in the same log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.plans import decisions

EVENTS = "observation_id long, status string, changed map<string,string>, mapping map<string,string>, author string, at timestamp"
RESET = "reset"


def append(path: str, decided: DataFrame, author: str, at: str, mapping: DataFrame | None = None) -> str:
    """Write decisions (observation_id, status and, of modified ones, changed) as events; `mapping` has observation_id, value
    and new of those that bring their own.  Gives the name of the write."""
    own = decided if "changed" in decided.columns else decided.withColumn("changed", F.lit(None).cast("map<string,string>"))
    if mapping is None:
        told = own.withColumn("mapping", F.lit(None).cast("map<string,string>"))
    else:
        given = mapping.groupBy("observation_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("mapping"))
        told = own.join(given, "observation_id", "left")
    name = uuid.uuid4().hex
    told.select("observation_id", "status", "changed", "mapping", F.lit(author).alias("author"), F.lit(at).cast("timestamp").alias("at")).coalesce(1).write.parquet(f"{path}/write={name}")
    return name


def reset(path: str, spark: SparkSession, observation_ids: list[int], author: str, at: str) -> str:
    """Take decisions back, as an event."""
    return append(path, spark.createDataFrame([(k, RESET) for k in observation_ids], "observation_id long, status string"), author, at)


def history(spark: SparkSession, path: str) -> DataFrame:
    """Every event with the name of its write."""
    return spark.read.schema(EVENTS + ", write string").parquet(path)


def replay(spark: SparkSession, path: str, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions (observation_id, status, changed) as they stand, or stood at a time, and the mappings of modified ones."""
    events = history(spark, path)
    if until is not None:
        events = events.filter(F.col("at") <= F.lit(until).cast("timestamp"))
    last = events.groupBy("observation_id").agg(F.max_by(F.struct("status", "changed", "mapping"), F.struct("at", "write")).alias("e")).select("observation_id", "e.*").filter(F.col("status") != RESET)
    mapping = last.filter((F.col("status") == decisions.MODIFIED) & F.col("mapping").isNotNull()).select("observation_id", F.explode("mapping").alias("value", "new"))
    return last.drop("mapping"), mapping
