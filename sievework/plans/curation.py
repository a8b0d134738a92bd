"""From observations to suggestions, decisions and a curated table with an audit trail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import BOOLEAN_WORDS, as_number, iso_date, trim

# What is suggested for an observation and how soon.
ACTIONS = {"missing_pattern": ("convert_na", 3), "duplicate": ("flag", 1), "constraint_violation": ("flag", 2), "cross_column_inconsistency": ("flag", 2), "pattern_violation": ("flag", 3)}
STEP = "__step"
PENALTY = {"error": 0.1, "warning": 0.02, "info": 0.005}


def number_observations(observations: DataFrame) -> DataFrame:
    """observation_id by severity, then the text of the observation: deterministic, few rows."""
    from pyspark.sql import Window

    weight = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return observations.withColumn("observation_id", F.row_number().over(Window.orderBy(weight, "detector", "column", "type", "occurrences")).cast("long"))


def suggestions(observations: DataFrame) -> DataFrame:
    """observation_id, action, priority: at most one for each observation."""
    t, s, share = F.col("type"), F.col("severity"), F.col("percentage")
    action = (
        F.when(t == "inconsistency", F.when(F.col("detector") == "date_format_validator", "convert_date").otherwise("standardize"))
        .when(t == "type_mismatch", F.when(share < 10, "coerce").otherwise("flag"))
        .when(t == "outlier", "flag")
        .when(t == "completeness", F.when(share >= 20, "flag"))
    )
    priority = F.when(t == "inconsistency", 2).when(t == "type_mismatch", F.when(share < 10, 3).otherwise(2)).when(t == "outlier", F.when(s == "error", 2).otherwise(4)).when(t == "completeness", 4)
    for kind, (name, order) in ACTIONS.items():
        action, priority = action.when(t == kind, name), priority.when(t == kind, order)
    return observations.select("observation_id", "column", action.alias("action"), priority.cast("int").alias("priority")).filter("action is not null")


def pending(suggested: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions without a decision."""
    return suggested.join(decisions.select("observation_id"), "observation_id", "left_anti")


def severity_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("severity").agg(F.count("*").alias("n"), F.sum("occurrences").alias("occurrences"))


def quality_score(observations: DataFrame, columns: int) -> DataFrame:
    """One row: the share of clean columns less a penalty for each observation, between 0 and 1."""
    penalty = reduce(lambda a, b: a + b, [F.count_if(F.col("severity") == s) * F.lit(w) for s, w in PENALTY.items()])
    clean = 1 - F.count_distinct("column") / F.lit(float(max(columns, 1)))
    return observations.agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), clean - F.least(F.lit(0.5), penalty))), 6).alias("score"))


def standardize(c: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return c
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c], c)


def convert_na(c: Column, tokens: list[str]) -> Column:
    return F.when(F.lower(c).isin([t.lower() for t in tokens]), "").otherwise(c)


def coerce(c: Column, kind: str) -> Column:
    """Text of the kind; what can't be read becomes empty."""
    v = trim(c)
    if kind == "integer":
        n = as_number(v)
        return F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise("")
    if kind == "float":
        return F.when(as_number(v).isNotNull(), v).otherwise("")
    if kind == "boolean":
        yes, no = BOOLEAN_WORDS[0::2], BOOLEAN_WORDS[1::2]
        return F.when(F.lower(v).isin(yes), "true").when(F.lower(v).isin(no), "false").otherwise("")
    return c


def apply_operations(rows: DataFrame, operations: list[tuple[str, str, dict]]) -> tuple[DataFrame, DataFrame]:
    """The curated rows and the audit: _row_id, column, original, new, reason of every changed cell.  Operations are
    (action, column, parameters) in order, each seeing what those before have done; all are one projection chain, which
    the audit reads once: each step leaves its change beside the row.  Columns whose names start with __step are refused."""
    if any(c.startswith(STEP) for c in rows.columns):
        raise ValueError(f"columns may not start with {STEP}")
    out, changes, new_cell = rows, [], F.col(f"{STEP}_new")
    for action, column, given in operations:
        c = F.col(f"`{column}`")
        if action == "flag":
            flag = given.get("flag_column", f"{column}_flagged")
            old = F.col(f"`{flag}`") if flag in out.columns else F.lit("")
            out = out.withColumn(flag, F.when(given["where"], given.get("value", "flagged")).otherwise(old))
            continue
        new = {"standardize": lambda: standardize(c, given["mapping"]), "convert_na": lambda: convert_na(c, given["tokens"]), "coerce": lambda: coerce(c, given["kind"]), "convert_date": lambda: iso_date(c)}[action]()
        change = F.struct(F.lit(column).alias("column"), c.alias("original"), new_cell.alias("new"), F.lit(action).alias("reason"))
        changes.append(f"{STEP}_{len(changes)}")
        out = out.withColumn(f"{STEP}_new", new).withColumn(changes[-1], F.when(c != new_cell, change)).withColumn(column, new_cell).drop(f"{STEP}_new")
    if not changes:
        return out, rows.sparkSession.createDataFrame([], "_row_id long, column string, original string, new string, reason string")
    return out.drop(*changes), out.select("_row_id", F.inline(F.array_compact(F.array(*changes))))


def with_audit_columns(curated: DataFrame, audit: DataFrame) -> DataFrame:
    """curated and three text columns: what was changed in the row, from what, and why."""
    entry = F.struct("column", "original", "new", "reason")
    told = audit.groupBy("_row_id").agg(F.array_sort(F.collect_list(entry)).alias("a"))

    def text(field: str) -> Column:
        return F.array_join(F.transform("a", lambda x: F.concat_ws("=", x["column"], x[field])), "; ")

    return curated.join(told.select("_row_id", text("new").alias("_modified"), text("original").alias("_original"), text("reason").alias("_reason")), "_row_id", "left")
