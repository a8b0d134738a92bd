"""Decisions on suggestions, the document that keeps them, and the texts and figures that summarise a table."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How a confidence moves with the domain, the type of observation and its evidence.
DOMAIN = {"biomedical": 0.10, "clinical": 0.10, "environmental": 0.05}
OTHER_DOMAIN = -0.05
RELIABILITY = {"type_mismatch": 0.1, "constraint_violation": 0.1, "outlier": -0.1}
ACCEPTED, REJECTED, MODIFIED = "accepted", "rejected", "modified"


def decide(suggested: DataFrame, decisions: DataFrame | None, status: str, action: str | None = None, column: str | None = None) -> DataFrame:
    """decisions and one for each suggestion without any that has the action (part of its name) and column (any case)."""
    if status not in (ACCEPTED, REJECTED, MODIFIED):
        raise ValueError(f"no such status: {status}")
    wanted = F.lit(True)
    if action is not None:
        wanted &= F.col("action").contains(action) | F.lit(action).contains(F.col("action"))
    if column is not None:
        wanted &= F.lower("column") == column.lower()
    new = suggested.filter(wanted).select("observation_id", F.lit(status).alias("status"))
    if decisions is None:
        return new
    return decisions.unionByName(new.join(decisions.select("observation_id"), "observation_id", "left_anti"), allowMissingColumns=True)


def decide_one(suggested: DataFrame, decisions: DataFrame | None, observation_id: int, status: str) -> DataFrame:
    """decisions and one more; an unknown suggestion or one that is decided already is an error."""
    own = suggested.filter(F.col("observation_id") == observation_id)
    if own.isEmpty():
        raise KeyError(f"no suggestion for {observation_id}")
    if decisions is not None and not decisions.filter(F.col("observation_id") == observation_id).isEmpty():
        raise ValueError(f"{observation_id} is decided already")
    return decide(own, decisions, status)


#: What a modification may say of a suggestion: where and how a flag is set, which text is missing, what cells become.
CHANGES = ("flag_column", "flag_value", "pattern", "kind")


def modify(suggested: DataFrame, decisions: DataFrame | None, observation_id: int, **changed: str) -> DataFrame:
    """decisions and one that accepts a suggestion with other parameters (of CHANGES), in a column `changed`; the mapping of a
    standardization is a table, see plans.apply.apply_decided."""
    unknown = sorted(set(changed) - set(CHANGES))
    if unknown:
        raise ValueError(f"no such parameters: {unknown}")
    one = decide_one(suggested, decisions if decisions is None else decisions.select("observation_id", "status"), observation_id, MODIFIED).filter(F.col("observation_id") == observation_id)
    words = [F.lit(x) for kv in changed.items() for x in kv]
    new = one.withColumn("changed", (F.create_map(*words) if words else F.create_map()).cast("map<string,string>"))
    return new if decisions is None else decisions.unionByName(new, allowMissingColumns=True)


def reset(decisions: DataFrame, observation_ids: list[int]) -> DataFrame:
    return decisions.filter(~F.col("observation_id").isin(observation_ids))


def progress(suggested: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: suggestions, how many are accepted, rejected, modified or pending, and the share that is decided."""
    joined = suggested.select("observation_id").join(decisions, "observation_id", "left")
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (ACCEPTED, REJECTED, MODIFIED)]
    out = joined.agg(F.count("*").alias("n"), *counts, F.count_if(F.col("status").isNull()).alias("n_pending"))
    return out.withColumn("progress", F.when(F.col("n") == 0, 1.0).otherwise(F.round((F.col("n") - F.col("n_pending")) / F.col("n"), 6)))


def merge_suggestions(rules: DataFrame, other: DataFrame) -> DataFrame:
    """Suggestions (observation_id, action, rationale) of two sources: of two for one observation the longer rationale stays."""
    o = other.select("observation_id", F.col("action").alias("_action"), F.col("rationale").alias("_rationale"))
    joined = rules.join(o, "observation_id", "full_outer")
    longer = F.coalesce(F.length("_rationale") > F.length("rationale"), F.lit(False))
    return joined.select("observation_id", F.coalesce("action", "_action").alias("action"), F.when(longer, F.col("_rationale")).otherwise(F.coalesce("rationale", "_rationale")).alias("rationale"))


def calibrated(domain: str) -> Column:
    """The confidence of an observation in a domain, between 0 and 1."""
    change = F.lit(DOMAIN.get(domain, OTHER_DOMAIN))
    for kind, by in RELIABILITY.items():
        change += F.when(F.col("type") == kind, by).otherwise(0.0)
    change += F.when(F.col("occurrences") > 5, 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + change)), 6)


def recommendation(errors: Column, warnings: Column, score: Column) -> Column:
    """What to do first."""
    return (
        F.when(errors > 0, F.format_string("Address %d error-level issues before proceeding with analysis.", errors))
        .when(warnings > 5, F.format_string("Review %d warning-level issues to improve data quality (score: %.0f%%).", warnings, score * 100))
        .when(score >= 0.9, "Data quality is good. Minor issues detected for review.")
        .when(score >= 0.7, "Data quality is acceptable. Consider addressing warnings.")
        .otherwise("Data quality needs attention. Review all observations.")
    )


def rollup(observations: DataFrame) -> DataFrame:
    """Observations by severity and type, with the totals of both (null: all)."""
    return observations.cube("severity", "type").agg(F.count("*").alias("n"))


def save(path: str, observations: DataFrame, suggested: DataFrame, decisions: DataFrame, updated_at: str) -> None:
    """Write the small tables of a curation as one JSON file; a file that is there goes to the history folder first."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.exists():
        history = target.with_suffix(".history")
        history.mkdir(exist_ok=True)
        shutil.copy(target, history / (json.loads(target.read_text())["updated_at"].replace(":", "-") + ".json"))
    tables = {n: [r.asDict() for r in df.collect()] for n, df in (("observations", observations), ("suggestions", suggested), ("decisions", decisions))}
    target.write_text(json.dumps({"updated_at": updated_at, "schemas": {n: df.schema.jsonValue() for n, df in (("observations", observations), ("suggestions", suggested), ("decisions", decisions))}, **tables}, indent=2))


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from pyspark.sql.types import StructType

    kept = json.loads(Path(path).read_text())
    return {n: spark.createDataFrame([tuple(r.values()) for r in kept[n]], StructType.fromJson(s)) for n, s in kept["schemas"].items()}


def history(path: str) -> list[Path]:
    """Earlier versions of the file, newest first."""
    return sorted(Path(path).with_suffix(".history").glob("*.json"), reverse=True)
