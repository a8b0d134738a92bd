"""Texts about columns and observations: what a column seems to hold, why an observation matters, what to do about it, why
its confidence moved, and requests with which a language model could be asked for the same.

All is made of the profile (a row for each column) and the observations (few rows) by joins and column expressions, so that
the same tables always give the same texts, and no call leaves the cluster.  A provider of one's own may answer the requests;
its proposals meet those of the rules in `decisions.merge_suggestions`.

Defined cases: an observation without a column of the profile has type 'unknown'; one of a kind without a rule gets the general
explanation and no proposal; null sample rows, shares and counts leave their part of a text out; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.plans import decisions

# What is proposed for a kind of observation, how soon (1 first) and how surely.
PROPOSED = {"missing_pattern": ("convert_na", 2, 0.9), "inconsistency": ("standardize", 3, 0.85), "outlier": ("flag", 4, 0.7), "type_mismatch": ("coerce", 3, 0.75), "duplicate": ("flag", 2, 0.8), "completeness": ("flag", 3, 0.7)}
INSIGHT_CONFIDENCE = 0.85
#: Texts; {column}, {type} and {domain} are filled in.
WHY = {
    "missing_pattern": "'{column}' spells missing data as ordinary text, which analyses of {domain} would count as values.",
    "inconsistency": "'{column}' ({type}) writes the same thing in more than one way, so groups of it fall apart.",
    "outlier": "'{column}' ({type}) has values far from the others: slips of entry, or rare cases that are right.",
    "type_mismatch": "'{column}' is mostly {type}, but some of its values cannot be read as that.",
    "duplicate": "'{column}' should tell rows apart, yet some of its values repeat.",
}
OTHERWISE = "'{column}' has a finding of kind {kind} that may lower the quality of the data; see its evidence."
DO = {
    "missing_pattern": "Turn the spellings of missing data in '{column}' into nulls.",
    "outlier": "Look at the far values of '{column}' before trusting them.",
    "type_mismatch": "Read '{column}' as its type, and look at what cannot be read.",
    "duplicate": "Decide for the repeated values of '{column}' whether to merge, remove or keep them.",
    "completeness": "Say why '{column}' has gaps, or fill them.",
}
#: What standardizing means, by the check that found the inconsistency.
STANDARDIZE = {
    "case_variant_validator": "Write '{column}' in one case.",
    "typo_validator": "Check the likely typos of '{column}' and put them right.",
    "semantic_equivalence_validator": "Use one word for each meaning in '{column}'.",
    "consistency_validator": "Write '{column}' as true and false.",
    "date_format_validator": "Write the dates of '{column}' in one format, best as year-month-day.",
}
STANDARDIZE_OTHERWISE = "Write the values of '{column}' in one way."
#: What a kind of observation mostly comes from.
CAUSE = {"missing_pattern": "nulls that were written as text", "inconsistency": "entry by several hands or a change of format", "outlier": "slips of entry or rare cases", "duplicate": "rows entered twice or keys in conflict"}
CAUSE_OTHERWISE = "something that a person should look at"
ACTIONS = ["standardize", "convert_na", "coerce", "flag", "remove", "merge"]
ROLES = ["identifier", "grouping", "covariate", "outcome", "metadata"]


def _fill(text: str, **parts: Column) -> Column:
    """The text with columns in place of its names in braces."""
    out, rest = [], text
    while rest:
        name = min((n for n in parts if f"{{{n}}}" in rest), key=lambda n: rest.index(f"{{{n}}}"), default=None)
        if name is None:
            out.append(F.lit(rest))
            break
        before, _, rest = rest.partition(f"{{{name}}}")
        out += [F.lit(before), parts[name]]
    return F.concat(*out)


def _by(c: Column, texts: dict[str, str], otherwise: str | None, **parts: Column) -> Column:
    out = F.lit(None).cast("string") if otherwise is None else _fill(otherwise, **parts)
    for kind, text in texts.items():
        out = F.when(c == kind, _fill(text, **parts)).otherwise(out)
    return out


def _percent(share: Column) -> Column:
    return F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))


def _also(label: str, c: Column) -> Column:
    """A further sentence, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f" {label}: "), c, F.lit(".")), F.lit(""))


def _base(observations: DataFrame) -> Column:
    """The column that an observation is about: labels of checks may name a part after '='."""
    return F.substring_index("column", "=", 1)


def column_insights(profile: DataFrame, domain: str = "general") -> DataFrame:
    """column, insight, confidence."""
    text = _fill("'{column}' looks like {role} in {domain} data: {type} with {n} distinct values.", column=F.col("column"), role=F.col("semantic_role"), domain=F.lit(domain), type=F.coalesce("inferred_type", F.lit("unknown")), n=F.col("unique_count").cast("string"))
    return profile.select("column", text.alias("insight"), F.lit(INSIGHT_CONFIDENCE).alias("confidence"))


def explained(observations: DataFrame, profile: DataFrame, domain: str = "the data") -> DataFrame:
    """observations and their explanation."""
    types = profile.select(F.col("column").alias("__name"), F.col("inferred_type").alias("__type"))
    joined = observations.withColumn("__base", _base(observations)).join(F.broadcast(types), F.col("__base") == F.col("__name"), "left")
    text = _by(F.col("type"), WHY, OTHERWISE, column=F.col("__base"), type=F.coalesce("__type", F.lit("unknown")), domain=F.lit(domain), kind=F.col("type"))
    return joined.withColumn("explanation", text).drop("__base", "__name", "__type")


def proposals(observations: DataFrame) -> DataFrame:
    """observation_id, action, priority, confidence, rationale.  Where observations have evidence, the rationale names
    their first rows (sample_rows); that of gaps names their share (percentage)."""
    kind, column = F.col("type"), _base(observations)
    action, priority, sure = (F.lit(None).cast(t) for t in ("string", "int", "double"))
    for k, (a, p, c) in PROPOSED.items():
        action, priority, sure = F.when(kind == k, a).otherwise(action), F.when(kind == k, p).otherwise(priority), F.when(kind == k, c).otherwise(sure)
    text = F.when(kind == "inconsistency", _by(F.col("detector"), STANDARDIZE, STANDARDIZE_OTHERWISE, column=column)).otherwise(_by(kind, DO, None, column=column))
    if "sample_rows" in observations.columns:
        text = F.concat(text, F.when(kind.isin("outlier", "type_mismatch"), _also("First rows", F.array_join("sample_rows", ", "))).otherwise(""))
    text = F.concat(text, F.when(kind == "completeness", _also("Percent missing", F.round("percentage", 1).cast("string"))).otherwise(""))
    return observations.select("observation_id", action.alias("action"), priority.alias("priority"), sure.alias("confidence"), text.alias("rationale")).filter("action is not null")


def factors(observations: DataFrame, domain: str = "general") -> DataFrame:
    """observation_id, factor, impact: what moves an observation's confidence.  Their sum, held between 0 and 1 with the
    confidence, is decisions.calibrated."""
    by_kind = F.lit(None).cast("double")
    for k, by in {**decisions.RELIABILITY, "inconsistency": 0.0}.items():
        by_kind = F.when(F.col("type") == k, by).otherwise(by_kind)
    all_of = [("domain", F.lit(decisions.DOMAIN.get(domain, decisions.OTHER_DOMAIN))), ("kind", by_kind), ("evidence", F.when(F.col("occurrences") > 5, 0.05))]
    said = F.array(*[F.struct(F.lit(n).alias("factor"), c.cast("double").alias("impact")) for n, c in all_of])
    return observations.select("observation_id", F.inline(said)).filter("impact is not null")


def reasoned(observations: DataFrame, domain: str = "general") -> DataFrame:
    """observation_id, confidence, calibrated, reasoning: the sentence goes by the sum of the factors, not by what is left
    after the bounds."""
    moved = factors(observations, domain).groupBy("observation_id").agg(F.round(F.sum("impact"), 6).alias("__moved"))
    word = F.when(F.col("__moved") >= 0, "raised").otherwise("lowered")
    text = _fill("Confidence {word} from {old} to {new} for {domain} data.", word=word, old=_percent(F.col("confidence")), new=_percent(F.col("calibrated")), domain=F.lit(domain))
    return observations.withColumn("calibrated", decisions.calibrated(domain)).join(moved, "observation_id").select("observation_id", "confidence", "calibrated", text.alias("reasoning"))


def answers(observations: DataFrame, domain: str = "general") -> DataFrame:
    """observation_id, answer: what to say when a person asks about an observation."""
    cause = _by(F.col("type"), CAUSE, CAUSE_OTHERWISE)
    text = _fill("{detector} found {n} cells of kind {kind} in '{column}'. In {domain} data this mostly comes from {cause}. It is {sure} sure.", detector=F.col("detector"), n=F.coalesce(F.col("occurrences").cast("string"), F.lit("some")), kind=F.col("type"), column=_base(observations), domain=F.lit(domain), cause=cause, sure=_percent(F.col("confidence")))
    return observations.select("observation_id", text.alias("answer"))


def column_requests(profile: DataFrame, samples: DataFrame, domain: str = "general") -> DataFrame:
    """column, request: a text that asks a language model about a column, with its profile and first values (profile.sample_values)."""
    told = F.to_json(F.struct("column", "inferred_type", "semantic_role", "count", "null_count", "unique_count", "is_unique", "low", "high", F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"), F.lit(domain).alias("domain")))
    ask = f"Say in one or two sentences what this column of a table holds. Answer as JSON with insight, role (null or one of {', '.join(ROLES)}), issues (or null) and confidence from 0 to 1."
    return profile.join(samples, "column", "left").select("column", F.concat(F.lit(ask + "\n"), told).alias("request"))


def observation_requests(observations: DataFrame, profile: DataFrame, domain: str = "general") -> DataFrame:
    """observation_id, request: a text that asks a language model what to do about an observation."""
    types = F.broadcast(profile.select(F.col("column").alias("__name"), "inferred_type", "semantic_role"))
    known = [c for c in ("type", "severity", "column", "detector", "confidence", "occurrences", "percentage", "sample_rows", "value_counts") if c in observations.columns]
    told = F.to_json(F.struct(*known, "inferred_type", "semantic_role", F.lit(domain).alias("domain")))
    ask = f"Propose what to do about this finding. Answer as JSON with action (null or one of {', '.join(ACTIONS)}), rationale, parameters, confidence from 0 to 1 and priority from 1 (first) to 10."
    return observations.join(types, _base(observations) == F.col("__name"), "left").select("observation_id", F.concat(F.lit(ask + "\n"), told).alias("request"))
