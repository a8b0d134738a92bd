"""The whole analysis of one table: value dictionary, profile, every check that applies, observations.

Cells are grouped to the value dictionary, which is written to the shared folder: the profile, the rounds that find
quartiles, the one pass for all checks of values and whatever is asked of an analysis later read it there.  What the checks
of rows ask is grouped apart and only summed.  Both are cut by rows, so that a task's groups do not follow the input.  What
comes to the driver has a row for each column and check; observations are few and local.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import is_missing
from sievework.operators import profile, values
from sievework.operators import validators as V
from sievework.plans import checks as K
from sievework.plans.curation import number_observations
from sievework.sources.shared import parts, sized, staged

OBSERVED = "check string, type string, severity string, column string, detector string, confidence double, occurrences long, share double"


@dataclass
class Analysis:
    """rows in text form (with the key, where it names rows), their value dictionary, the profile of columns, observations,
    and what the checks were chosen by."""

    rows: DataFrame
    values: DataFrame
    profile: DataFrame
    observations: DataFrame
    table: K.Table
    checks: list[K.Check]
    row_checks: list[K.RowCheck]


def _seen(check: K.Check | K.RowCheck, label: str, occurrences: int, severity: str, share: float | None = None) -> tuple:
    certain = V.CONFIDENCE[check.detector] if check.confidence is None else check.confidence
    return check.name, check.kind, severity, label, check.detector, certain, occurrences, share


def _observed(spark: SparkSession, found: list[tuple], total: int) -> DataFrame:
    share = F.coalesce("share", F.round(F.col("occurrences") * 100.0 / max(total, 1), 4))
    return number_observations(spark.createDataFrame([f for f in found if f[6] > 0], OBSERVED).withColumn("percentage", share).drop("share"))


def analyze(df: DataFrame, key: str, checks: list[K.Check] | None = None, row_checks: list[K.RowCheck] | None = None) -> Analysis:
    """Checks are chosen by names and by the profile, which has a row for each column; `checks` and `row_checks` replace
    those of the registry."""
    checks, row_checks = checks or K.CHECKS, row_checks or K.ROW_CHECKS
    rows = values.to_text(values.spread_out(df), key)
    columns = [c for c in rows.columns if c != "_row_id"]
    ids = [c for c in columns if profile.named_role(c) == "identifier"]
    table = K.Table(columns, ids, K.identifier_of(df.columns, ids))
    if table.identifier == key:
        rows = rows.withColumn(key, F.col("_row_id").cast("string"))
    spark = df.sparkSession
    n = rows.count()
    with sized(spark, n):
        cut = rows.repartition(parts(n)) if rows.rdd.getNumPartitions() < parts(n) else rows
        cells = K.grouped(K.entries(cut, table, [])).select("column", "value", "n", "first_row")
        dictionary = staged(cells.withColumn("missing", is_missing(F.col("value"))), "values")
        profiled = profile.schema_profile(dictionary)
        table.profile = {r["column"]: r for r in profiled.collect()}
        table.total = max((p["count"] for p in table.profile.values()), default=0)
        found = _rows_checked(K.grouped(K.asked_of_rows(cut, table, row_checks)), table, row_checks) + _values_checked(dictionary, table, checks)
    schema = profiled.schema
    return Analysis(rows, dictionary, spark.createDataFrame(list(table.profile.values()), schema), _observed(spark, found, table.total), table, checks, row_checks)


def _rows_checked(groups: DataFrame, table: K.Table, row_checks: list[K.RowCheck]) -> list[tuple]:
    n = F.col("n")
    sums = groups.groupBy("check", "column").agg(F.count("*").alias("groups"), F.sum(n).alias("total"), F.max(n).alias("most"), F.sum(F.when(F.col("differs"), 1).otherwise(0)).alias("spelled"), F.sum(n - 1).alias("repeated"))
    got = {(r.check, r["column"]): K.Tally(*r[2:]) for r in sums.collect()}
    return [_seen(c, label, *f) for c in row_checks for label in c.columns(table) if (c.name, label) in got for f in c.findings(got[c.name, label], table, label)]


def _values_checked(dictionary: DataFrame, table: K.Table, checks: list[K.Check]) -> list[tuple]:
    few = [c for c in table.profile if table.profile[c].semantic_type in ("categorical", "binary") and 0 < table.profile[c].unique_count <= K.SET_VALUES]
    for r in dictionary.filter(F.col("column").isin(few) & ~F.col("missing")).select("column", "value").collect() if few else []:  # SET_VALUES a column
        table.sets.setdefault(r["column"], []).append(r.value)
    numeric = [c for c in table.of_type("integer", "float") if table.profile[c].low is not None]
    table.bounds = V.iqr_bounds(dictionary, numeric) if numeric else {}
    by_check = K.tallies(K.groups_of(K.spread(dictionary, table, checks)))
    wrong = V.typo_pairs(dictionary, [c for c in table.of_type("string") if c not in table.ids]).groupBy("column").agg(F.count("*").alias("total"))
    zero = F.lit(0).cast("long")
    both = by_check.unionByName(wrong.select(F.lit("typo").alias("check"), F.col("column").alias("label"), F.col("total").alias("groups"), "total", zero.alias("most"), zero.alias("spelled"), zero.alias("repeated")))
    by_name = {c.name: c for c in checks}
    found = []
    for r in both.collect():
        tally = K.Tally(*r[2:])
        if r.check == "typo":
            found.append(("typo", "inconsistency", "warning", r.label, "typo_validator", V.CONFIDENCE["typo_validator"], tally.total, None))
        else:
            check = by_name[r.check]
            found += [_seen(check, r.label, *f, share=check.percentage) for f in check.findings(tally, table, r.label)]
    for c, p in table.profile.items():
        if p["count"] and table.share(p.null_count) >= 5:
            found.append(("completeness", "completeness", "error" if table.share(p.null_count) >= 20 else "warning", c, "completeness_validator", V.CONFIDENCE["completeness_validator"], p.null_count, None))
    return found


def quality_report(df: DataFrame, key: str) -> DataFrame:
    """observation_id, type, severity, column, detector, occurrences, percentage of a table."""
    return analyze(df, key).observations.select("observation_id", "type", "severity", F.col("column"), "detector", "occurrences", "percentage")
