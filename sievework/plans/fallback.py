"""Mappings for standardizations that come without one, from three sources in this order.

1. Evidence: in each group of spellings with counts, all go to the most common one (of equals the least text).
2. Data, for variants of case: the spellings of the column that agree in small letters go to the most common one (of equals
   the one that is seen first last).
3. Text, for typos: pairs in quotes with an arrow between them, as descriptions of observations have them.

Each step is a join or an explosion of the observations; the data step joins the value dictionary, whose size is free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import trim
from sievework.sources.shared import staged

# Fixed value: how descriptions write a pair.
ARROW = "'([^']*)' → '([^']*)'"


def from_evidence(observations: DataFrame) -> DataFrame:
    """observation_id, value, new from value_counts (VARIANT: group to spelling to count)."""
    counts = F.from_json(F.to_json("value_counts"), "map<string,map<string,bigint>>")
    groups = observations.select("observation_id", F.explode(counts).alias("g", "spellings")).select("observation_id", "g", F.explode("spellings").alias("value", "n"))
    best = groups.groupBy("observation_id", "g").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("new"))
    return groups.join(best, ["observation_id", "g"]).filter("value <> new").select("observation_id", "value", "new")


def from_data(observations: DataFrame, values: DataFrame) -> DataFrame:
    """observation_id, value, new from the spellings of the observations' columns."""
    asked = F.broadcast(observations.select("column").distinct())  # a row for each column at most
    spelled = values.filter("not missing").join(asked, "column", "left_semi").groupBy("column", F.lower(trim(F.col("value"))).alias("g"), trim(F.col("value")).alias("value")).agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
    mine = observations.select("observation_id", "column").join(spelled, "column")
    best = mine.groupBy("observation_id", "g").agg(F.max_by("value", F.struct("n", "first_row")).alias("new"))
    return mine.join(best, ["observation_id", "g"]).filter("value <> new").select("observation_id", "value", "new")


def from_text(observations: DataFrame) -> DataFrame:
    """observation_id, value, new from the pairs of a description; of two for one text the later holds."""
    sides = [F.regexp_extract_all("description", F.lit(ARROW), F.lit(k)) for k in (1, 2)]
    pairs = observations.select("observation_id", F.posexplode(F.arrays_zip(sides[0].alias("value"), sides[1].alias("new"))).alias("at", "p"))
    return pairs.groupBy("observation_id", F.col("p.value").alias("value")).agg(F.max_by("p.new", "at").alias("new"))


def fallback_mapping(observations: DataFrame, values: DataFrame) -> DataFrame:
    """observation_id, value, new and source (evidence, data, text) for observations of inconsistency: observation_id, type,
    column, description and value_counts.  A later source is asked only where those before it say nothing."""
    # Every source reads the observations, and what made their counts may be a whole analysis.
    asked = staged(observations.filter("type = 'inconsistency'"), "asked")
    by_evidence = from_evidence(asked).withColumn("source", F.lit("evidence"))
    left = asked.join(by_evidence.select("observation_id").distinct(), "observation_id", "left_anti")
    variants, typos = left.filter("lower(description) like '%case variant%'"), left.filter("lower(description) not like '%case variant%' and description like '%typo%'")
    by_data = from_data(variants, values).withColumn("source", F.lit("data"))
    return by_evidence.unionByName(by_data).unionByName(from_text(typos).withColumn("source", F.lit("text")))
