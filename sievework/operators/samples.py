"""Checks of sample tables: sex and pregnancy, age and diagnosis, coordinates, collection dates, readiness to submit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import as_integer, as_number, is_missing, trim
from sievework.operators import taxonomy
from sievework.operators.validators import PREGNANT_MALE, YOUNG_PATIENT, observation
from sievework.operators.values import value_dictionary

# Fixed values.
PREGNANT = ["yes", "y", "true", "1"]
ADULT_CONDITIONS = ["type 2 diabetes", "t2d", "menopause", "prostate"]
CHILD_AGE = 12
PLACEHOLDERS = ["missing", "not collected", "not applicable", "na"]
PAIR = r"^([+-]?[0-9.]+)[NSEWnsew]*\s+([+-]?[0-9.]+)[NSEWnsew]*\z"
COLLECTION_DATE = r"(?s)^(.{4}-.{2}-.{2}|.{4}-.{2}|[0-9]{4})\z"
ACCEPTED_NULLS = ["missing", "not collected", "not applicable", "not provided", "restricted access", "missing: not collected", "missing: not provided", "missing: restricted access"]
BAD_NULLS = ["n/a", "na", "null", "none", "unknown", "-", "--", ".", "?", "undefined", "empty", "blank", "nil"]
#: Parts of organisms' names that suit the packages of human samples; mismatches of more rows are not reported.
OF_HUMANS = ["homo", "human", "metagenome", "streptococcus", "staphylococcus", "bacteroides", "escherichia", "lactobacillus", "bifidobacterium", "clostridium", "prevotella", "faecalibacterium", "gut", "oral", "skin"]
MISMATCHES = 5
STRICT_DATE = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?\z"
PENALTIES = {"duplicate": 30, "organism": 25, "date": 10, "coordinates": 10, "null": 5, "mismatch": 5}


def _rows(rows: DataFrame, bad: Column, name: str, severity: str, total: int, confidence: float) -> DataFrame:
    found = rows.agg(F.count_if(bad).alias("occurrences")).withColumn("column", F.lit(name)).filter("occurrences > 0")
    return observation(found, "cross_column_inconsistency", severity, "cross_column_validator", total, confidence=confidence)


def is_pregnant_male(sex: str, pregnant: str) -> Column:
    s, p = F.lower(F.col(f"`{sex}`")), F.lower(F.col(f"`{pregnant}`"))
    male = (s.contains("male") & ~s.contains("female")) | (s == "m")
    return male & p.isin(PREGNANT)


def pregnant_males(rows: DataFrame, sex: str, pregnant: str, total: int) -> DataFrame:
    return _rows(rows, is_pregnant_male(sex, pregnant), f"{sex} vs {pregnant}", "error", total, PREGNANT_MALE)


def is_young_patient(age: str, diagnosis: str) -> Column:
    """Whether a child has a condition of adults."""
    years, d = as_integer(trim(F.col(f"`{age}`"))), F.lower(F.col(f"`{diagnosis}`"))
    return (years <= CHILD_AGE) & d.rlike("|".join(ADULT_CONDITIONS))


def young_patients(rows: DataFrame, age: str, diagnosis: str, total: int) -> DataFrame:
    return _rows(rows, is_young_patient(age, diagnosis), f"{age} vs {diagnosis}", "warning", total, YOUNG_PATIENT)


def latitude_longitude(c: Column) -> Column:
    """Whether a text is a placeholder or two numbers in range, each perhaps with a letter for its direction."""
    v = trim(c)
    lat, lon = (as_number(F.regexp_extract(v, PAIR, g)) for g in (1, 2))
    return F.lower(v).isin(PLACEHOLDERS) | F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def collection_date(c: Column) -> Column:
    """Whether a text is a placeholder or has the shape of a year, with a month, with a day."""
    return F.lower(trim(c)).isin(PLACEHOLDERS) | c.rlike(COLLECTION_DATE)


def invalid_values(values: DataFrame, column: str, valid: Column) -> DataFrame:
    """column and the rows whose value is there but not valid."""
    return values.filter((F.col("column") == column) & ~F.col("missing")).groupBy("column").agg(F.sum(F.when(~valid, F.col("n")).otherwise(0)).alias("n_invalid"), F.sum("n").alias("n"))


def many_booleans(values: DataFrame, columns: list[str]) -> DataFrame:
    """column and spellings of yes/no columns that are written in more than two ways; tokens for missing values count."""
    v = trim(F.col("value"))
    return values.filter(F.col("column").isin(columns) & (v != "")).groupBy("column").agg(F.count_distinct(v).alias("spellings")).filter("spellings > 2")


def readiness(rows: DataFrame, content: list[str], date: str, place: str) -> DataFrame:
    """One row: duplicate samples, bad dates and places, and the score of 0 to 100 left of them.  Duplicates block.
    submission_readiness is the whole check, with organisms and missing values."""
    total = F.count("*")
    key = F.concat_ws("|", *[F.lower(trim(F.col(c))) for c in content])
    groups = rows.groupBy(key.alias("k")).agg(
        total.alias("n"),
        F.count_if(~is_missing(F.col(date)) & ~F.col(date).rlike(STRICT_DATE)).alias("dates"),
        F.count_if(~is_missing(F.col(place)) & ~latitude_longitude(F.col(place))).alias("places"),
    )
    found = groups.agg(F.sum("n").alias("samples"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_duplicate"), F.sum("dates").alias("n_bad_date"), F.sum("places").alias("n_bad_place"))
    lost = F.col("n_duplicate") * PENALTIES["duplicate"] + F.col("n_bad_date") * PENALTIES["date"] + F.col("n_bad_place") * PENALTIES["coordinates"]
    score = F.floor(F.greatest(F.lit(0.0), 100 - lost / F.col("samples"))).cast("int")
    return found.select("samples", "n_duplicate", "n_bad_date", "n_bad_place", F.coalesce(score, F.lit(0)).alias("score"), (F.col("n_duplicate") == 0).alias("is_ready"))


def invalid_organisms(values: DataFrame, column: str) -> DataFrame:
    """One row, n_bad_organism: rows whose organism is abbreviated or invalid.  An unknown name of two words is let pass."""
    there = values.filter((F.col("column") == column) & (F.col("value") != "") & ~F.lower("value").isin(ACCEPTED_NULLS))
    named = taxonomy.match(there, column).filter(~((F.col("status") == "valid") | ((F.col("status") == "unknown") & F.col("value").contains(" ") & (F.octet_length("value") >= 5))))
    bad = named.select("n").unionByName(there.filter("missing").select("n"))
    return bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bad_organism"))


def submission_readiness(rows: DataFrame, content: list[str], date: str, place: str, organism: str, human_package: bool = False) -> DataFrame:
    """readiness, and bad organisms (which block), missing values that are not written as accepted (in all columns), and
    organisms that do not suit a package of human samples.  Organisms and tokens come from the value dictionary."""
    values = value_dictionary(rows)
    nulls = values.agg(F.coalesce(F.sum(F.when(F.lower(trim(F.col("value"))).isin(BAD_NULLS), F.col("n"))), F.lit(0)).alias("n_bad_null"))
    name = F.lower("value")
    strange = (F.col("column") == organism) & (name != "") & ~name.isin(ACCEPTED_NULLS) & ~name.rlike("|".join(OF_HUMANS))
    unlike = values.agg(F.coalesce(F.sum(F.when(strange & F.lit(human_package), F.col("n"))), F.lit(0)).alias("u")).select(F.when(F.col("u") <= MISMATCHES, F.col("u")).otherwise(0).alias("n_mismatch"))
    base = readiness(rows, content, date, place).drop("score", "is_ready")
    joined = base.crossJoin(invalid_organisms(values, organism)).crossJoin(nulls).crossJoin(unlike)  # one row each
    kinds = {"n_duplicate": "duplicate", "n_bad_organism": "organism", "n_bad_date": "date", "n_bad_place": "coordinates", "n_bad_null": "null"}
    lost = sum((F.col(c) * PENALTIES[k] for c, k in kinds.items()), F.lit(0)) / F.nullif(F.col("samples"), F.lit(0))
    score = F.floor(F.greatest(F.lit(0.0), 100 - lost - F.when(F.col("n_mismatch") > 0, PENALTIES["mismatch"]).otherwise(0))).cast("int")
    score = F.when(F.col("samples") > 0, score).otherwise(0)
    return joined.select("*", score.alias("score"), ((F.col("n_duplicate") == 0) & (F.col("n_bad_organism") == 0)).alias("is_ready"))
