"""Organism names: expansion of abbreviations, exact and case-blind lookup, nearest name within a few edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import as_integer, trim
from sievework.operators.nearest import nearest_names
from sievework.operators.organisms import ORGANISMS

# Common abbreviations.
ABBREVIATIONS = [
    ("E. coli", "Escherichia coli"), ("S. aureus", "Staphylococcus aureus"), ("B. subtilis", "Bacillus subtilis"), ("P. aeruginosa", "Pseudomonas aeruginosa"),
    ("S. cerevisiae", "Saccharomyces cerevisiae"), ("C. elegans", "Caenorhabditis elegans"), ("D. melanogaster", "Drosophila melanogaster"),
    ("M. musculus", "Mus musculus"), ("H. sapiens", "Homo sapiens"), ("A. thaliana", "Arabidopsis thaliana"), ("B. fragilis", "Bacteroides fragilis"),
    ("C. difficile", "Clostridioides difficile"), ("F. prausnitzii", "Faecalibacterium prausnitzii"), ("L. reuteri", "Limosilactobacillus reuteri"), ("B. longum", "Bifidobacterium longum"),
]
ENTRIES = [tuple(part.strip() for part in line.split("|")) for line in ORGANISMS.strip().splitlines()]
NAMES = [(int(taxid), name) for taxid, name, _, _ in ENTRIES]


def names(spark: SparkSession) -> DataFrame:
    """taxid, name, rank, common_names of the organisms that are built in."""
    rows = [(int(taxid), name, rank, [c for c in common.split("; ") if c]) for taxid, name, rank, common in ENTRIES]
    return spark.createDataFrame(rows, "taxid long, name string, rank string, common_names array<string>")


def keys(dictionary: DataFrame) -> DataFrame:
    """key (a name or common name in small letters) and name; a name goes before a common name, then the least name."""
    own = dictionary.select(F.lower("name").alias("key"), "name", F.lit(0).alias("kind"))
    if "common_names" in dictionary.columns:
        own = own.unionByName(dictionary.select(F.explode("common_names").alias("key"), "name").select(F.lower("key").alias("key"), "name", F.lit(1).alias("kind")))
    return own.groupBy("key").agg(F.min_by("name", F.struct("kind", "name")).alias("name"))


def by_rank(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("rank").agg(F.count("*").alias("n"))


def read_dump(spark: SparkSession, names_path: str, nodes_path: str | None = None) -> DataFrame:
    """taxid, name, common_names, rank from a taxonomy dump (fields split by a bar between tabs)."""
    part = F.split(F.regexp_replace("value", r"\t\|\z", ""), r"\t\|\t")
    rows = spark.read.text(names_path).select(part.alias("p")).select(F.col("p")[0].cast("long").alias("taxid"), F.col("p")[1].alias("name"), F.col("p")[3].alias("kind"))
    kept = rows.filter(F.col("kind").isin("scientific name", "common name", "genbank common name"))
    out = kept.groupBy("taxid").agg(F.max(F.when(F.col("kind") == "scientific name", F.col("name"))).alias("name"), F.array_sort(F.collect_list(F.when(F.col("kind") != "scientific name", F.col("name")))).alias("common_names"))
    if nodes_path is None:
        return out.withColumn("rank", F.lit("no rank"))
    nodes = spark.read.text(nodes_path).select(part.alias("p")).select(F.col("p")[0].cast("long").alias("taxid"), F.col("p")[2].alias("rank"))
    return out.join(nodes, "taxid", "left").withColumn("rank", F.coalesce("rank", F.lit("no rank")))


def match(values: DataFrame, column: str, dictionary: DataFrame | None = None) -> DataFrame:
    """value, n, status (valid, case_error, abbreviation, possible_typo, unknown) and name.  A common name is a
    case error, an abbreviation of a name that is not listed is looked up as it is.  Only distinct values meet the
    dictionary; those that it doesn't have walk tries of its names."""
    spark = values.sparkSession
    listed = dictionary if dictionary is not None else names(spark)
    known = keys(listed)
    short = spark.createDataFrame([(k, full) for a, full in ABBREVIATIONS for k in (a.lower(), a.replace(".", "").lower())], "key string, full string")
    short = short.join(listed.select(F.col("name").alias("full")), "full", "left_semi")  # others are looked up as they are
    own = values.filter((F.col("column") == column) & ~F.col("missing")).groupBy(trim(F.col("value")).alias("value")).agg(F.sum("n").alias("n")).withColumn("key", F.lower("value"))
    placed = own.join(F.broadcast(short), "key", "left").join(known, "key", "left")
    left = placed.filter("full is null and name is null").select("key")
    best = nearest_names(left, listed, 2).select("key", F.col("name").alias("near"))
    status = F.when(F.col("full").isNotNull(), "abbreviation").when(F.col("name") == F.col("value"), "valid").when(F.col("name").isNotNull(), "case_error").when(F.col("near").isNotNull(), "possible_typo").otherwise("unknown")
    return placed.join(best, "key", "left").select("value", "n", status.alias("status"), F.coalesce("full", "name", "near").alias("name"))


def by_taxid(values: DataFrame, column: str, dictionary: DataFrame | None = None) -> DataFrame:
    """taxid, n, name and rank of the whole numbers among a column's texts; name and rank are null where a number is not
    listed, other texts have no row.  Only distinct numbers meet the dictionary."""
    listed = dictionary if dictionary is not None else names(values.sparkSession)
    asked = values.filter((F.col("column") == column) & ~F.col("missing")).groupBy(as_integer(trim(F.col("value"))).alias("taxid")).agg(F.sum("n").alias("n"))
    return asked.filter("taxid is not null").join(listed.select("taxid", "name", "rank"), "taxid", "left").select("taxid", "n", "name", "rank")


def nearest(values: DataFrame, column: str, edits: int = 3, dictionary: DataFrame | None = None) -> DataFrame:
    """value, name, edits: the nearest known name of each text within some edits, the least name of equals."""
    known = dictionary if dictionary is not None else names(values.sparkSession)
    own = values.filter((F.col("column") == column) & ~F.col("missing")).select(trim(F.col("value")).alias("value")).distinct().withColumn("key", F.lower("value"))
    return own.join(nearest_names(own, known, edits), "key").select("value", "name", "edits")
