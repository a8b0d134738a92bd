"""From accepted decisions to a curated table: what each suggestion needs, the steps in order, and the change log.

Observations, suggestions and decisions have a row for each finding and are read on the driver; mappings of values stay
tables and are joined, so their size is free.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import as_number, is_missing, iso_date, parses_as, title_case, trim
from sievework.operators import validators as V
from sievework.plans import curation, decisions
from sievework.sources.shared import staged

# What the column of flags is called, by type of observation, and how sure a coercion is.
FLAG_ENDS = {"outlier": "_flagged", "duplicate": "_duplicate", "type_mismatch": "_type_error", "constraint_violation": "_constraint_violation", "pattern_violation": "_invalid_format"}
CROSS_FLAG, COERCE_CERTAINTY = "cross_column_issue", 0.9
PREFIX = curation.STEP
#: A mapping of at most so many bytes is broadcast to the rows; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def parameters(suggested: DataFrame, observations: DataFrame) -> DataFrame:
    """suggested with target (the column it changes), pattern (of missing values), flag_column, flag_value, confidence and
    affected_rows."""
    seen = observations.select("observation_id", "type", "severity", "detector", "confidence", "occurrences")
    joined = suggested.join(seen, "observation_id")
    t, missing = F.col("type"), F.col("type") == "missing_pattern"
    target = F.when(missing, F.regexp_extract("column", r"^(.*)=([^=]*)\z", 1)).otherwise(F.col("column"))
    end = F.create_map(*[F.lit(x) for kv in FLAG_ENDS.items() for x in kv])[t]
    flags = F.col("action") == "flag"
    name = F.when(t == "cross_column_inconsistency", CROSS_FLAG).otherwise(F.concat("column", end))
    value = F.when(t == "outlier", F.when(F.col("severity") == "error", "invalid_value").otherwise("outlier")).otherwise(t)
    sure = F.when(F.col("action") == "coerce", F.round(F.col("confidence") * COERCE_CERTAINTY, 6)).otherwise(F.col("confidence"))
    return joined.select("observation_id", "column", "action", "priority", "type", "detector", target.alias("target"), F.when(missing, F.regexp_extract("column", r"=([^=]*)\z", 1)).alias("pattern"), F.when(flags, name).alias("flag_column"), F.when(flags & name.isNotNull(), value).alias("flag_value"), sure.alias("confidence"), F.col("occurrences").alias("affected_rows"))


def _to_most_common(spelled: DataFrame, detector: str) -> DataFrame:
    """Spellings (column, g, value, n) of a group to its most common one, the least text of equals."""
    best = spelled.groupBy("column", "g").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("new"))
    return spelled.join(best, ["column", "g"]).filter(F.col("value") != F.col("new")).select("column", F.lit(detector).alias("detector"), "value", "new")


def mappings(values: DataFrame) -> DataFrame:
    """column, detector, value, new: what standardize would write for a text, by the check that found it."""
    there = values.filter("not missing")
    v, columns = trim(F.col("value")), [r["column"] for r in values.select("column").distinct().collect()]  # names of columns
    by_case = there.groupBy("column", F.lower(v).alias("g"), v.alias("value")).agg(F.sum("n").alias("n"))
    terms = there.withColumn("term", F.lower(v)).join(F.broadcast(V.synonym_frame(values)), "term")
    out = _to_most_common(by_case, "case_variant_validator")
    out = out.unionByName(_to_most_common(terms.select("column", F.col("canonical").alias("g"), "value", "n"), "semantic_equivalence_validator"))
    typos = V.typo_pairs(values, columns).select("column", F.lit("typo_validator").alias("detector"), F.col("typo").alias("value"), F.col("suggestion").alias("new"))
    titled = there.filter(F.col("value") != title_case(F.col("value"))).select("column", F.lit("title_case_validator").alias("detector"), "value", title_case(F.col("value")).alias("new"))
    return out.unionByName(typos).unionByName(titled)


def resolved(decided: DataFrame, suggested: DataFrame, observations: DataFrame) -> DataFrame:
    """decisions with their suggestion and its observation; a decision without either is an error."""
    lost = decided.join(suggested, "observation_id", "left_anti").select("observation_id").unionByName(suggested.join(observations, "observation_id", "left_anti").select("observation_id"))
    stray = [r.observation_id for r in lost.limit(5).collect()]
    if stray:
        raise ValueError(f"no suggestion or observation for {stray}")
    joined = decided.join(parameters(suggested, observations), "observation_id")
    if "changed" not in decided.columns:
        return joined.withColumn("kind", F.lit(None).cast("string"))
    # What a modification says goes before what was suggested.
    own = {c: F.coalesce(F.col("changed")[c], F.col(c)).alias(c) for c in ("flag_column", "flag_value", "pattern")}
    return joined.select(*[own.get(c, F.col(c)) for c in joined.columns if c != "changed"], F.col("changed")["kind"].alias("kind"))


def preview(decided: DataFrame, suggested: DataFrame, observations: DataFrame) -> DataFrame:
    """What accepted decisions would change: observation_id, column, action, type, detector, affected_rows."""
    return resolved(decided, suggested, observations).filter(F.col("status").isin(decisions.ACCEPTED, decisions.MODIFIED)).select("observation_id", "column", "action", "type", "detector", "affected_rows")


def status_report(observations: DataFrame, suggested: DataFrame, decided: DataFrame, columns: int) -> DataFrame:
    """measure, key, value of a curation: observations by severity, decisions by status, progress and score."""
    by = observations.groupBy(F.col("severity").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("observations").alias("measure"), "key", "value")
    done = decisions.progress(suggested, decided)
    parts = [F.struct(F.lit(m).alias("measure"), F.lit(k).alias("key"), F.col(c).cast("double").alias("value")) for m, k, c in [("suggestions", "all", "n"), *[("decisions", s, f"n_{s}") for s in ("accepted", "rejected", "modified", "pending")], ("progress", "all", "progress")]]
    score = curation.quality_score(observations, columns).select(F.lit("score").alias("measure"), F.lit("all").alias("key"), F.col("score").alias("value"))
    return by.unionByName(done.select(F.inline(F.array(*parts)))).unionByName(score)


def with_profile(observations: DataFrame, profile: DataFrame) -> DataFrame:
    """observations beside the profile of their column; those of a pair or of the whole table have none."""
    return observations.join(profile.select("column", "inferred_type", "semantic_type", "semantic_role"), "column", "left")


@dataclass
class Curated:
    rows: DataFrame
    audit: DataFrame


def _fault(kind: str, c: Column, expected: str | None) -> Column | None:
    """Which cells an observation is about, where the cell alone tells."""
    if kind == "type_mismatch" and expected:
        return ~is_missing(c) & ~parses_as(c, F.lit(expected))
    return {"outlier": F.coalesce(as_number(trim(c)) < 0, F.lit(False)), "completeness": is_missing(c)}.get(kind)


def _changed(step, decision_changes: DataFrame | None) -> DataFrame | None:
    """The mapping of a decision that was modified, if it has its own."""
    return None if decision_changes is None or step.status != decisions.MODIFIED else decision_changes.filter(F.col("observation_id") == step.observation_id)


def _hinted(mapping: DataFrame) -> DataFrame:
    """A mapping that is broadcast if it is small.  Cells hold few and frequent texts, and a shuffle by text would send
    all rows of a frequent one to one task."""
    texts = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in mapping.columns), F.lit(32))
    size = mapping.agg(F.coalesce(F.sum(texts), F.lit(0)).alias("bytes")).first().bytes
    return F.broadcast(mapping) if size <= BROADCAST_BYTES else mapping


def apply_decided(rows: DataFrame, plan: DataFrame, mapping: DataFrame, types: dict[str, str], marks: dict[int, str] | None = None, changes_of: DataFrame | None = None) -> Curated:
    """The rows after all accepted decisions of plan (from resolved), by priority, then observation, each step seeing what
    those before did, and the audit: _row_id, step, column, original, new, reason.  Coercions change the cells that fail
    their type only.  `marks` names, by observation, columns of rows that say which rows it is about (from
    plans.evidence.marked); they go, and each flag is set on its rows.  Without marks flags are set where the cell tells
    the fault (type, negative number, missing).  A modified decision takes its mapping from changes_of (observation_id,
    value, new) and its other parameters from the plan.  Decisions on columns that are not there change nothing.  Columns
    whose names start with __step are refused."""
    marks = marks or {}
    if any(c.startswith(PREFIX) for c in rows.columns):
        raise ValueError(f"columns may not start with {PREFIX}")
    accepted = plan.filter(F.col("status").isin(decisions.ACCEPTED, decisions.MODIFIED))
    out, changes = rows, []
    steps = accepted.orderBy("priority", "observation_id").collect()  # a row for each decision
    if any(s.action == "standardize" for s in steps):
        mapping = staged(mapping, "mapping")  # made once, not once for each step and again for rows and audit
    for k, step in enumerate(steps):
        if step.action == "flag" and step.observation_id in marks:
            old = F.col(f"`{step.flag_column}`") if step.flag_column in out.columns else F.lit("")
            out = out.withColumn(step.flag_column, F.when(F.col(f"`{marks[step.observation_id]}`"), step.flag_value).otherwise(old))
            continue
        if step.target not in rows.columns:
            continue
        kind = step.kind or types.get(step.target)
        c, fault = F.col(f"`{step.target}`"), _fault(step.type, F.col(f"`{step.target}`"), kind)
        if step.action == "flag":
            if step.flag_column and fault is not None:
                old = F.col(f"`{step.flag_column}`") if step.flag_column in out.columns else F.lit("")
                out = out.withColumn(step.flag_column, F.when(fault, step.flag_value).otherwise(old))
            continue
        if step.action == "standardize":
            given = _changed(step, changes_of)
            own = (mapping.filter((F.col("column") == step.target) & (F.col("detector") == step.detector)) if given is None else given).select(F.col("value").alias(f"{PREFIX}_v"), F.col("new").alias(f"{PREFIX}_n"))
            out = out.join(_hinted(own), c == F.col(f"{PREFIX}_v"), "left")
            new = F.coalesce(F.col(f"{PREFIX}_n"), c)
        elif step.action == "convert_na":
            new = curation.convert_na(c, [step.pattern])
        elif step.action == "coerce" and fault is not None:
            new = F.when(fault, curation.coerce(c, kind)).otherwise(c)
        elif step.action == "convert_date":
            new = iso_date(c)
        else:
            continue
        out = out.withColumn(f"{PREFIX}_new", new)
        change = F.when(c != F.col(f"{PREFIX}_new"), F.struct(F.lit(k).alias("step"), F.lit(step.target).alias("column"), c.alias("original"), F.col(f"{PREFIX}_new").alias("new"), F.lit(step.action).alias("reason")))
        changes.append(f"{PREFIX}_{k}")
        out = out.withColumn(changes[-1], change).withColumn(step.target, F.col(f"{PREFIX}_new")).drop(f"{PREFIX}_new", f"{PREFIX}_v", f"{PREFIX}_n")
    if not changes:
        none = rows.sparkSession.createDataFrame([], "_row_id long, step int, column string, original string, new string, reason string")
        return Curated(out.drop(*marks.values()), none)
    return Curated(out.drop(*changes, *marks.values()), out.select("_row_id", F.inline(F.array_compact(F.array(*changes)))))


def change_log(audit: DataFrame) -> DataFrame:
    """column, reason, cells and rows that were changed."""
    return audit.groupBy("column", "reason").agg(F.count("*").alias("cells"), F.count_distinct("_row_id").alias("rows"))
