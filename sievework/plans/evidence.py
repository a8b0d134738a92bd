"""What observations rest on: the rows they are about, and their first groups with counts.

Every check of an analysis names the rows it is about.  A check of values or rows with a condition is an expression over the
row, so marking its rows moves nothing.  Where rows or values are compared, the groups in question are found once for all
observations and written to the shared folder; few of them are broadcast, and many are joined by their keys, each SALT times,
so that one large group is spread over as many tasks.

Rows of duplicates and of repeated identifiers are those after the first of their group; of near duplicates and of
identifiers with more than one content, all of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import is_missing, trim
from sievework.plans import checks as K
from sievework.plans.analyze import Analysis
from sievework.sources.shared import sized, staged

#: Parts of a group that is joined by its key; groups, spellings and rows that evidence holds.
SALT, FIRST = 16, 5
#: Groups of at most so many bytes are broadcast to the rows.
FEW_BYTES = 8 << 20
MARK = "__about_"


def _cell(rows: DataFrame, column: str, name: str, asked: Column) -> DataFrame:
    """rows with an expression over the cell of a column, whatever the rows' own columns are called."""
    cell = F.col(f"`{column}`")
    held = rows.select(F.struct("*").alias("__row"), F.lit(column).alias("column"), cell.alias("value"), trim(cell).alias("text"), F.lower(trim(cell)).alias("small"))
    return held.select("__row.*", asked.alias(name))


def _bytes(key: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(F.octet_length(key), F.lit(0)) + 32), F.lit(0))


def _keyed(rows: DataFrame, key: Column, offending: DataFrame, size: int, after_first: bool, name: str) -> DataFrame:
    """rows with whether their key is among offending ones (value, first_row), which have so many bytes."""
    held = offending.select(F.col("value").alias("__value"), F.col("first_row").alias("__first"))
    asked = rows.withColumn("__key", key).withColumn("__salt", F.pmod(F.xxhash64("_row_id"), F.lit(SALT)).cast("int"))
    if size <= FEW_BYTES:
        joined = asked.join(F.broadcast(held.withColumn("__part", F.lit(0))), F.col("__key") == F.col("__value"), "left")
    else:
        parts = held.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = asked.join(parts, (F.col("__key") == F.col("__value")) & (F.col("__salt") == F.col("__part")), "left")
    about = F.col("__value").isNotNull() & ((F.col("_row_id") > F.col("__first")) if after_first else F.lit(True))
    return joined.withColumn(name, about).drop("__key", "__salt", "__value", "__first", "__part")


def _compared(analysis: Analysis, asked: list[tuple[str, str]]) -> tuple[DataFrame | None, dict]:
    """Of the checks that compare values, the groups (check, label, key, first_row) that the asked observations are about,
    in one pass, and for each check and label their bytes."""
    checks = [c for c in analysis.checks if c.group and any(c.name == name for name, _ in asked)]
    if not checks:
        return None, {}
    labels = F.array(*[F.concat_ws("\0", F.lit(c), F.lit(label)) for c, label in asked])
    named = {kind: F.col("check").isin([c.name for c in checks if c.group == kind]) for kind in ("spelled", "minority")}
    offending = F.when(named["spelled"], F.col("spelled")).otherwise(named["minority"] | (F.col("total") > 1))
    with sized(analysis.rows.sparkSession, analysis.table.total):
        mine = K.spread(analysis.values, analysis.table, checks).filter(F.array_contains(labels, F.concat_ws("\0", "check", "label")))
        groups = staged(K.groups_of(mine).filter(offending).select("check", "label", "key", "total", "first_row"), "groups")
        largest = groups.filter(named["minority"]).groupBy("check", "label").agg(F.max_by("key", F.struct("total", "key")).alias("largest")).collect()  # a row for each finding
        for r in largest:
            groups = groups.filter(~((F.col("check") == r.check) & (F.col("label") == r.label) & (F.col("key") == r.largest)))
        sizes = groups.groupBy("check", "label").agg(_bytes("key").alias("size")).collect()  # a row for each finding
    return groups, {(r.check, r.label): r["size"] for r in sizes}


def _mark(rows: DataFrame, analysis: Analysis, compared: tuple[DataFrame | None, dict], check: str, label: str, name: str) -> DataFrame | None:
    table = analysis.table
    if check == "completeness":
        return rows.withColumn(name, is_missing(F.col(f"`{label}`")))
    by_row = next((c for c in analysis.row_checks if c.name == check), None)
    if by_row is not None:
        own = by_row.columns(table)[label]
        if by_row.bad is not None:
            return rows.withColumn(name, F.coalesce(by_row.bad(*own), F.lit(False)))
        repeated = by_row.other is None
        with sized(rows.sparkSession, table.total):
            groups = K.grouped(K.asked_of_rows(analysis.rows, table, [by_row])).filter(F.col("check") == check)
            offending = staged(groups.filter("n > 1" if repeated else "differs"), "groups")
            size = offending.agg(_bytes("value").alias("size")).first()["size"]
        return _keyed(rows, by_row.key(*own), offending, size, repeated, name)
    by_value = next((c for c in analysis.checks if c.name == check), None)
    if by_value is None:
        return None
    column = label.rpartition("=")[0] if by_value.part else label
    given = by_value.columns(table).get(column)
    bad = by_value.bad(given) if by_value.missing else ~is_missing(F.col("value")) & by_value.bad(given)
    if by_value.part:
        bad &= F.col(by_value.part) == label.rpartition("=")[2]
    if by_value.group is None:
        return _cell(rows, column, name, F.coalesce(bad, F.lit(False)))
    groups, sizes = compared
    offending = groups.filter((F.col("check") == check) & (F.col("label") == label)).withColumnRenamed("key", "value")
    found = _keyed(_cell(rows, column, "__asked", F.when(bad, by_value.key(given))), F.col("__asked"), offending, sizes.get((check, label), 0), by_value.group == "repeated", name)
    return found.drop("__asked")


def marked(analysis: Analysis, observations: DataFrame) -> tuple[DataFrame, dict[int, str]]:
    """The rows with a column for each of the observations that says whether it is about the row, and the names of these
    columns by observation_id.  Typos mark nothing, as they are put right and not flagged."""
    rows, names = analysis.rows, {}
    asked = observations.select("observation_id", "check", "column").orderBy("observation_id").collect()  # a row for each finding
    compared = _compared(analysis, [(o.check, o["column"]) for o in asked])
    for o in asked:
        name = f"{MARK}{o.observation_id}"
        done = _mark(rows, analysis, compared, o.check, o["column"], name)
        if done is not None:
            rows, names[o.observation_id] = done, name
    return rows, names


def about(analysis: Analysis, observations: DataFrame) -> DataFrame:
    """observation_id and _row_id of every row that an observation is about."""
    rows, names = marked(analysis, observations)
    if not names:
        return rows.select(F.lit(0).cast("long").alias("observation_id"), "_row_id").filter("false")
    ids = F.array(*[F.when(F.col(name), F.lit(k).cast("long")) for k, name in names.items()])
    return rows.select(F.explode(ids).alias("observation_id"), "_row_id").filter("observation_id is not null")


def _ranked(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("rank") <= FIRST)


def first_rows(analysis: Analysis, observations: DataFrame) -> DataFrame:
    """observation_id and _row_id of the first rows that each observation is about; a task hands on its own first ones."""
    rows, names = marked(analysis, observations)
    if not names:
        return about(analysis, observations)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(0, np.int64) for k in names}
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, k in enumerate(names, 1):
                mine = np.concatenate([held[k], ids[b.column(at).fill_null(False).to_numpy(zero_copy_only=False)]])
                held[k] = np.partition(mine, FIRST)[:FIRST] if len(mine) > FIRST else mine
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), np.int64), [len(v) for v in held.values()])), pa.array(np.concatenate(list(held.values())))], names=["observation_id", "_row_id"])

    first = rows.select("_row_id", *names.values()).mapInArrow(least, "observation_id long, _row_id long")
    return _ranked(first, ["observation_id"], ["_row_id"])


def first_groups(analysis: Analysis, names: list[str] | None = None) -> DataFrame:
    """check, column and value_counts (of all checks or those named): of the first groups of values (by their first row) that a check is about, the first
    spellings with their rows, as VARIANT.  Groups of one spelling are left out where spellings are what is compared."""
    checks = [c for c in analysis.checks if names is None or c.name in names]
    spreaded = K.spread(analysis.values, analysis.table, checks)
    compared = [c.name for c in analysis.checks if c.group == "spelled"]
    groups = K.groups_of(spreaded).filter(F.col("spelled") | ~F.col("check").isin(compared))
    spark, total = analysis.rows.sparkSession, analysis.table.total
    with sized(spark, total):
        first = staged(_ranked(groups, ["check", "label"], ["first_row", "key"]).select("check", "label", "key", F.col("rank").alias("place")), "first")
    spelled = spreaded.join(F.broadcast(first), ["check", "label", "key"]).groupBy("check", "label", "key", "place", "spelling").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
    with sized(spark, total):
        spelled = staged(spelled, "spelled")
    few = _ranked(spelled, ["check", "label", "key", "place"], ["first_row", "spelling"])
    one = few.groupBy("check", "label", "place", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("spelling", "n")))).alias("counts"))
    whole = one.groupBy("check", "label").agg(F.map_from_entries(F.collect_list(F.struct("key", "counts"))).alias("counts"))
    return whole.select("check", F.col("label").alias("column"), F.parse_json(F.to_json("counts")).alias("value_counts"))


def evidence(analysis: Analysis, observations: DataFrame | None = None) -> DataFrame:
    """observations (all, or some of the analysis) with sample_rows (the first rows they are about, in order) and
    value_counts (VARIANT, or null)."""
    asked = analysis.observations if observations is None else observations
    rows = first_rows(analysis, asked).groupBy("observation_id").agg(F.array_sort(F.collect_list("_row_id")).alias("sample_rows"))
    names = [r.check for r in asked.select("check").distinct().collect()]  # names of checks
    return asked.join(rows, "observation_id", "left").join(first_groups(analysis, names), ["check", "column"], "left")
