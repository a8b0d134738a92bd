"""Checklists of sample metadata: which fields a package asks for, which columns hold them, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import trim
from sievework.operators.validators import observation

# Packages with the spellings that stand for them (small letters without - _ and space).
PACKAGES = {
    "air": ["air"], "built environment": ["builtenvironment", "built", "indoor"], "host-associated": ["hostassociated", "host"],
    "human-associated": ["humanassociated", "human"], "human-gut": ["humangut", "gut", "intestinal", "fecal", "stool"],
    "human-oral": ["humanoral", "oral", "mouth", "saliva"], "human-skin": ["humanskin", "skin", "dermal"], "human-vaginal": ["humanvaginal", "vaginal"],
    "microbial mat/biofilm": ["microbialmat", "biofilm", "mat"], "miscellaneous": ["miscellaneous", "misc", "other"], "plant-associated": ["plantassociated", "plant"],
    "sediment": ["sediment"], "soil": ["soil"], "wastewater/sludge": ["wastewater", "sludge", "sewage"], "water": ["water", "aquatic", "marine", "freshwater"],
}
# Package (none: all), field, requirement, other names of the field.
FIELDS = [
    (None, "investigation_type", "mandatory", []), (None, "project_name", "mandatory", ["study_name", "project", "study"]),
    (None, "lat_lon", "mandatory", ["latitude_longitude", "geo_loc", "coordinates"]), (None, "geo_loc_name", "mandatory", ["geographic_location", "location", "country"]),
    (None, "collection_date", "mandatory", ["sample_date", "date_collected", "sampling_date"]), (None, "env_broad_scale", "mandatory", ["biome", "environment_biome", "env_biome"]),
    (None, "env_local_scale", "mandatory", ["feature", "environment_feature", "env_feature"]), (None, "env_medium", "mandatory", ["material", "environment_material", "env_material", "sample_material"]),
    (None, "seq_meth", "recommended", ["sequencing_method", "platform", "seq_platform"]), (None, "samp_size", "recommended", ["sample_size", "amount"]),
    ("human-gut", "host_subject_id", "mandatory", ["subject_id", "patient_id", "participant_id"]), ("human-gut", "host_age", "recommended", ["age", "subject_age"]),
    ("human-gut", "host_sex", "recommended", ["sex", "gender"]), ("human-gut", "host_disease_stat", "recommended", ["disease", "diagnosis", "health_status"]),
    ("human-gut", "host_body_site", "mandatory", ["body_site", "sample_site", "tissue"]), ("human-gut", "samp_collect_device", "recommended", []),
    ("human-gut", "gastrointest_disord", "conditional", ["gi_disorder", "gastrointestinal"]),
    ("soil", "depth", "mandatory", []), ("soil", "elev", "mandatory", []), ("soil", "soil_type", "recommended", []), ("soil", "ph", "recommended", []),
    ("water", "depth", "mandatory", []), ("water", "temp", "recommended", []), ("water", "salinity", "recommended", []),
]


def package_of(c: Column) -> Column:
    """The package that a text names, or null."""
    known = {s: name for name, spellings in PACKAGES.items() for s in spellings}
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.regexp_replace(F.lower(c), r"[-_ ]", "")]


def fields(spark: SparkSession, package: str | None = None) -> DataFrame:
    """position, field and requirement of what a package asks for; without one, of what all do."""
    asked = [(k, f, r) for k, (p, f, r, _) in enumerate(FIELDS) if p in (None, package)]
    return spark.createDataFrame(asked, "position int, field string, requirement string")


def matched(columns: DataFrame, package: str | None = None) -> DataFrame:
    """column (from columns), field and requirement: a column holds the first field whose name or other name it has."""
    names = [(n, k, f, r) for k, (p, f, r, other) in enumerate(FIELDS) if p in (None, package) for n in (f, *other)]
    known = columns.sparkSession.createDataFrame(names, "name string, position int, field string, requirement string")
    joined = columns.join(F.broadcast(known), F.regexp_replace(F.lower("column"), "[- ]", "_") == F.col("name"))
    return joined.groupBy("column").agg(F.min_by(F.struct("field", "requirement"), "position").alias("f")).select("column", "f.field", "f.requirement")


def missing_fields(columns: DataFrame, package: str | None, total: int) -> DataFrame:
    """An observation for each mandatory field that no column holds: all rows lack it."""
    asked = fields(columns.sparkSession, package).filter("requirement = 'mandatory'")
    lost = asked.join(F.broadcast(matched(columns, package)), "field", "left_anti").select(F.col("field").alias("column"), F.lit(total).alias("occurrences"))
    return observation(lost, "completeness", "error", "mixs_compliance", total)


def compliance(columns: DataFrame, package: str | None) -> DataFrame:
    """One row: mandatory fields, those that a column holds, and their share (0 without a package)."""
    asked = fields(columns.sparkSession, package).filter("requirement = 'mandatory'")
    found = asked.join(F.broadcast(matched(columns, package).select("field", F.lit(1).alias("held"))), "field", "left").agg(F.count("*").alias("n_mandatory"), F.count("held").alias("n_found"))
    share = F.round(F.col("n_found") / F.col("n_mandatory"), 6) if package else F.lit(0.0)
    return found.select("n_mandatory", "n_found", share.alias("score"))


def packages_of_samples(values: DataFrame, column: str) -> DataFrame:
    """package and n: how many rows of a column name each package."""
    named = values.filter((F.col("column") == column) & ~F.col("missing")).withColumn("package", package_of(trim(F.col("value"))))
    return named.filter("package is not null").groupBy("package").agg(F.sum("n").alias("n"))
