"""OBO files: a row for each term, and the lookup of texts among labels and synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """id, label, definition, synonyms, parents of every term; a stanza is one record of the file."""
    stanza = spark.read.option("lineSep", "\n[").text(path).select(F.col("value").alias("s")).filter(F.col("s").rlike(r"^\[?Term\]"))

    def one(tag: str) -> Column:
        return F.nullif(F.regexp_extract("s", rf"(?m)^{tag}: ?(.*)$", 1), F.lit(""))

    def many(pattern: str) -> Column:
        return F.regexp_extract_all("s", F.lit(pattern), F.lit(1))

    terms = stanza.select(one("id").alias("id"), one("name").alias("label"), F.nullif(F.regexp_extract("s", r'(?m)^def: "([^"]*)"', 1), F.lit("")).alias("definition"), many(r'(?m)^synonym: "([^"]*)"').alias("synonyms"), many(r"(?m)^is_a: ?(\S+)").alias("parents"))
    return terms.filter("id is not null")


def lookup(values: DataFrame, terms: DataFrame) -> DataFrame:
    """value, id, confidence: a label counts 1, a synonym 0.95; of several terms the surest one, then the least id."""
    label = terms.select(F.lower("label").alias("key"), "id", F.lit(1.0).alias("confidence"))
    synonym = terms.select(F.explode("synonyms").alias("key"), "id").select(F.lower("key").alias("key"), "id", F.lit(0.95).alias("confidence"))
    own = values.select("value").distinct().withColumn("key", F.lower(F.trim("value")))
    met = own.join(label.unionByName(synonym), "key")
    return met.groupBy("value").agg(F.min_by(F.struct("id", "confidence"), F.struct(-F.col("confidence"), F.col("id"))).alias("b")).select("value", "b.id", "b.confidence")
