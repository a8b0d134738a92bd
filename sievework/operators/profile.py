"""Column profiles: counts, type votes, moments, order statistics, semantic types and roles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import as_integer, as_number, value_type

#: Ties of a type vote go to the earlier type.
TYPE_ORDER = ["integer", "float", "boolean", "date", "datetime", "string"]
# What a column's name says about its role, in this order.
ROLE_PATTERNS = [
    (r"(?i)^(id|_id$|identifier|key|uuid|guid)", "identifier"),
    (r"(?i)(sample[_\s]?id|patient[_\s]?id|subject[_\s]?id|record[_\s]?id)", "identifier"),
    (r"(?i)^(name|title|label)$", "identifier"),
    (r"(?i)(group|category|class|type|status|state|phase)", "grouping"),
    (r"(?i)(diagnosis|treatment|condition|cohort|arm)", "grouping"),
    (r"(?i)(sex|gender|race|ethnicity)", "grouping"),
    (r"(?i)(age|weight|height|bmi|score)", "covariate"),
    (r"(?i)(count|number|amount|quantity|level|value)", "covariate"),
    (r"(?i)(percent|percentage|ratio|rate|proportion)", "covariate"),
    (r"(?i)(outcome|result|response|endpoint|survival)", "outcome"),
    (r"(?i)(death|event|relapse|recurrence)", "outcome"),
    (r"(?i)(date|time|timestamp|created|updated|modified)", "metadata"),
    (r"(?i)(version|batch|run|file|source|origin)", "metadata"),
    (r"(?i)(note|comment|description|remark)", "metadata"),
]
# What a value's form says, in this order.
FORMATS = [
    (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z", "email"),
    (r"^https?://", "url"),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z", "uuid"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "iso_date"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}", "iso_datetime"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z", "us_date"),
    (r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\z", "phone_us"),
    (r"^[0-9]{5}(-[0-9]{4})?\z", "zip_code"),
    (r"^[A-Z]{2,4}[_-]?[0-9]{3,}", "sample_id"),
    (r"^[0-9]{4}\.[A-Z]+\.[0-9]+", "sample_id_dotted"),
    (r"^[A-Z][A-Z0-9]{1,5}\z", "gene_symbol_candidate"),
    (r"(?i)^(true|false|yes|no|y|n|t|f)\z", "boolean"),
]
#: What a value of a form must have, told without a pattern; it spares long texts all patterns but a few.
_SIZE = F.octet_length
CHEAP = {
    "email": lambda v: v.contains("@"), "url": lambda v: v.startswith("http"), "uuid": lambda v: _SIZE(v) == 36, "iso_date": lambda v: _SIZE(v) == 10,
    "us_date": lambda v: _SIZE(v).between(8, 10), "phone_us": lambda v: _SIZE(v).between(10, 17), "zip_code": lambda v: _SIZE(v).isin(5, 10),
    "gene_symbol_candidate": lambda v: _SIZE(v).between(2, 6), "boolean": lambda v: _SIZE(v) <= 5,
}


def counts(values: DataFrame) -> DataFrame:
    """column, count, null_count, unique_count, is_unique."""
    there = ~F.col("missing")
    out = values.groupBy("column").agg(F.sum("n").alias("count"), F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).alias("null_count"), F.sum(there.cast("long")).alias("unique_count"))
    return out.withColumn("is_unique", (F.col("unique_count") == F.col("count") - F.col("null_count")) & (F.col("unique_count") > 0))


def type_vote(values: DataFrame) -> DataFrame:
    """column, inferred_type, confidence: the type of most values; integers with some floats are floats."""
    order = F.create_map(*[F.lit(x) for k, t in enumerate(TYPE_ORDER) for x in (t, -k)])
    votes = values.filter("not missing").groupBy("column", value_type(F.col("value")).alias("t")).agg(F.sum("n").alias("n"))
    won = votes.groupBy("column").agg(F.max_by("t", F.struct("n", order[F.col("t")])).alias("t"), F.max("n").alias("n"), F.sum("n").alias("total"), F.max((F.col("t") == "float").cast("int")).alias("floats"))
    mixed = (F.col("t") == "integer") & (F.col("floats") == 1)
    share = F.col("n") / F.col("total")
    return won.select("column", F.when(mixed, "float").otherwise(F.col("t")).alias("inferred_type"), F.round(F.when(mixed, share * 0.95).otherwise(share), 6).alias("confidence"))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments and nearest-rank quartiles of typed columns, in one pass without unpivoting."""
    parts = []
    for c in columns:
        v = F.col(f"`{c}`").cast("double")
        at = F.count(v)
        parts.append(F.struct(F.lit(c).alias("column"), at.alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def string_profile(values: DataFrame) -> DataFrame:
    """column, min_length, max_length, avg_length in bytes of the texts that are there."""
    size = F.octet_length("value")
    return values.filter("not missing").groupBy("column").agg(F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.round(F.sum(size * F.col("n")) / F.sum("n"), 6).alias("avg_length"))


def semantic_type(kind: Column, unique: Column, total: Column, low: Column, high: Column) -> Column:
    return (
        F.when(kind == "boolean", "binary")
        .when((kind == "integer") & (low >= 0), "count")
        .when(kind.isin("integer", "float") & (low >= 0) & (high <= 1), "proportion")
        .when(kind.isin("integer", "float", "date", "datetime"), "continuous")
        .when(unique == 2, "binary")
        .when(unique <= 20, "categorical")
        .when(unique == total, "identifier")
        .otherwise("free_text")
    )


def named_role(name: str) -> str:
    """role_of for a name at hand."""
    return next((role for pattern, role in ROLE_PATTERNS if re.search(pattern.replace("$", r"\Z"), name)), "unknown")


def role_of(name: Column) -> Column:
    out = F.lit("unknown")
    for pattern, role in reversed(ROLE_PATTERNS):
        out = F.when(name.rlike(pattern.replace("$", r"\z")), role).otherwise(out)
    return out


def format_vote(values: DataFrame) -> DataFrame:
    """column, format: the form of at least four fifths of the values."""
    form = F.lit(None).cast("string")
    for pattern, name in reversed(FORMATS):
        fits = F.col("value").rlike(pattern)
        form = F.when(CHEAP[name](F.col("value")) & fits if name in CHEAP else fits, name).otherwise(form)
    there = values.filter("not missing")
    total = there.groupBy("column").agg(F.sum("n").alias("total"))
    votes = there.groupBy("column", form.alias("format")).agg(F.sum("n").alias("n")).filter("format is not null")
    won = votes.groupBy("column").agg(F.max_by("format", F.struct("n", "format")).alias("format"), F.max("n").alias("n"))
    return won.join(F.broadcast(total), "column").filter(F.col("n") >= F.floor(F.col("total") * 0.8)).select("column", "format", "n")


def schema_profile(values: DataFrame) -> DataFrame:
    """A row for each column of a value dictionary, by one aggregation: counts, type, semantic type and role."""
    there, n = ~F.col("missing"), F.col("n")
    number = F.when(there, F.coalesce(as_integer(F.col("value")).cast("double"), as_number(F.col("value"))))
    read = values.select("column", "n", "missing", F.when(there, value_type(F.col("value"))).alias("t"), number.alias("number"), F.when(there, F.octet_length("value")).alias("size"))
    votes = [F.struct(F.coalesce(F.sum(F.when(F.col("t") == t, n)), F.lit(0)).alias("n"), F.lit(-k).alias("order"), F.lit(t).alias("t")) for k, t in enumerate(TYPE_ORDER)]
    sums = read.groupBy("column").agg(
        F.sum("n").alias("count"), F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("null_count"), F.sum(there.cast("long")).alias("unique_count"), F.array(*votes).alias("votes"),
        F.min("number").alias("low"), F.max("number").alias("high"), F.min("size").alias("min_length"), F.max("size").alias("max_length"), F.sum(F.col("size") * n).alias("bytes"),
    )
    kept = F.col("count") - F.col("null_count")
    won = sums.withColumn("won", F.when(kept > 0, F.array_max("votes")))
    mixed = (F.col("won.t") == "integer") & (F.col("votes")[TYPE_ORDER.index("float")]["n"] > 0)
    share = F.col("won.n") / kept
    typed = won.select(
        "column", "count", "null_count", "unique_count", ((F.col("unique_count") == kept) & (F.col("unique_count") > 0)).alias("is_unique"),
        F.when(mixed, "float").otherwise(F.col("won.t")).alias("inferred_type"), F.round(F.when(mixed, share * 0.95).otherwise(share), 6).alias("confidence"),
        "low", "high", "min_length", "max_length", F.round(F.when(kept > 0, F.col("bytes") / kept), 6).alias("avg_length"),
    )
    return typed.withColumn("semantic_type", semantic_type(F.col("inferred_type"), F.col("unique_count"), kept, F.col("low"), F.col("high"))).withColumn("semantic_role", role_of(F.col("column")))


def sample_values(values: DataFrame, k: int = 5) -> DataFrame:
    """column and its first k distinct texts, in the order of the rows."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("column").orderBy("first_row", "value"))
    first = values.filter("not missing").withColumn("rank", rank).filter(F.col("rank") <= k)
    return first.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("sample_values"))


# Parts of a column's name that say something.
HINTS = ["id", "date", "time", "count", "total", "mean", "avg", "sum", "min", "max", "std", "var", "pct", "percent", "num", "name", "type", "status", "group", "category"]


def name_hints(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[_\-.\s]"), lambda part: part.isin(HINTS))


def constraints(values: DataFrame, most: int = 20) -> DataFrame:
    """What could be required of a column: few enough values for a set, uniqueness, no missing value."""
    return counts(values).select("column", (F.col("unique_count") <= most).alias("in_set"), "is_unique", (F.col("null_count") == 0).alias("not_null"))


def z_outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """column and the number of values that are more than `limit` standard deviations from the mean."""
    v = F.col(f"`{column}`").cast("double")
    stats = df.agg(F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"))  # one row
    return df.crossJoin(F.broadcast(stats)).agg(F.count_if(F.abs(v - F.col("_mean")) / F.col("_std") > limit).alias("occurrences")).select(F.lit(column).alias("column"), "occurrences")
