"""What is inferred of a column beyond counts and votes: value patterns, constraints, roles by values, and their fusion.

All run on the value dictionary, so their cost follows the number of distinct texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import MISSING_PATTERNS, as_number, trim
from sievework.operators import profile, ranks
from sievework.sources.shared import staged

# How sure each finding is, and how much of it is kept.
BY_NAME, BY_FORMAT = 0.85, 0.6
SET, RANGE, UNIQUE, NOT_NULL = 0.90, 0.85, 0.95, 0.90
FEW, KEPT_COUNTS, PATTERN_SHARE, KEPT_CONSTRAINT = 20, 40, 0.9, 0.7
STATISTICAL, SEMANTIC, ROLE_FROM, SOURCE_FROM = 0.6, 0.4, 0.6, 0.3
FORMAT_ROLES = {"email": "identifier", "uuid": "identifier", "sample_id": "identifier", "sample_id_dotted": "identifier", "iso_date": "metadata", "iso_datetime": "metadata", "us_date": "metadata", "boolean": "grouping"}


def _times(run: Column) -> Column:
    return F.when(F.length(run) > 1, F.concat(F.lit("{"), F.length(run), F.lit("}"))).otherwise("")


def pattern_of(sample: Column) -> Column:
    """A pattern made from a text: runs of digits, capitals and other letters by class and length, the rest as it is."""
    runs = F.regexp_extract_all(sample, F.lit(r"([0-9]+|\p{Lu}+|[\p{L}&&[^\p{Lu}]]+|[^0-9\p{L}])"), F.lit(1))
    part = F.transform(
        runs,
        lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit(r"\d"), _times(r)))
        .when(r.rlike(r"^\p{Lu}"), F.concat(F.lit("[A-Z]"), _times(r)))
        .when(r.rlike(r"^\p{L}"), F.concat(F.lit("[a-z]"), _times(r)))
        .otherwise(F.regexp_replace(r, r"([\[\](){}.*+?^$\\|])", r"\\$1")),
    )
    return F.concat(F.lit("^"), F.array_join(part, ""), F.lit("$"))


def value_patterns(values: DataFrame) -> DataFrame:
    """column, pattern, score: the pattern of at least nine tenths of a column's values.  One pass finds what all values
    share (class of characters, length), a second one counts the rows that match."""
    v, there = F.col("value"), values.filter("not missing")
    size = F.octet_length(v)
    shared = there.groupBy("column").agg(
        F.min(size).alias("low"), F.max(size).alias("high"), F.min_by(v, "first_row").alias("first"),
        F.bool_and(v.rlike(r"^[0-9]*\z")).alias("digits"), F.bool_and(v.rlike(r"^\p{IsAlphabetic}*\z")).alias("letters"),
        F.bool_and(~v.rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]")).alias("capitals"), F.bool_and(v.rlike(r"^[\p{IsAlphabetic}\p{N}_-]*\z")).alias("plain"),
    )
    same = F.col("low") == F.col("high")
    counted = F.when(same, F.concat(F.lit(r"^\d{"), "low", F.lit("}$"))).otherwise(F.concat(F.lit(r"^\d{"), "low", F.lit(","), "high", F.lit("}$")))
    pattern = F.when(F.col("digits"), counted).when(F.col("letters") & F.col("capitals") & same, F.concat(F.lit("^[A-Z]{"), "low", F.lit("}$"))).when(F.col("plain"), pattern_of(F.col("first")))
    candidates = shared.select("column", pattern.alias("pattern")).filter("pattern is not null")  # one row a column
    fits = F.call_function("regexp", v, F.regexp_replace("pattern", r"\$\z", r"\\z"))
    scored = there.join(F.broadcast(candidates), "column").groupBy("column", "pattern").agg((F.sum(F.when(fits, F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))
    return scored.filter(F.col("score") >= PATTERN_SHARE).select("column", "pattern", F.round("score", 6).alias("score"))


def kept_counts(values: DataFrame, most: int = KEPT_COUNTS) -> DataFrame:
    """column, value, n of the columns with few enough distinct texts."""
    there = values.filter("not missing")
    few = there.groupBy("column").agg(F.count("*").alias("k")).filter(F.col("k") <= most)
    return there.join(F.broadcast(few), "column").select("column", "value", "n")


def missing_statistics(values: DataFrame) -> DataFrame:
    """column, pattern, n: tokens that look like a missing value (-1 too) and occur at least twice in a column."""
    token = F.lower(trim(F.col("value")))
    return values.filter(token.isin([*MISSING_PATTERNS, "-1"])).groupBy("column", token.alias("pattern")).agg(F.sum("n").alias("n")).filter("n >= 2")


def text_moments(values: DataFrame) -> DataFrame:
    """column, n, low, high, mean, std (of the population) and quartiles of the numbers among a column's texts, which are
    read untrimmed.  A column without numbers has no row.  The dictionary is read once; what follows has a row for each
    distinct number, and quartiles come from rounds of histograms.  Deviations are taken from the mean, not from sums of
    squares, so that large numbers of small spread keep their digits."""
    v, n = F.col("v"), F.col("n")
    read = values.filter("not missing").select("column", as_number(F.col("value")).alias("v"), "n").filter("v is not null")
    numbers = staged(read.groupBy("column", "v").agg(F.sum("n").alias("n")), "numbers")
    sums = numbers.groupBy("column").agg(F.sum("n").alias("count"), F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(v * n) / F.sum("n")).alias("mean"))
    spread = numbers.join(F.broadcast(sums), "column").groupBy("column").agg(F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum("n")).alias("std"))  # a row a column
    found = [(c, *q) for c, q in ranks.order_statistics(numbers).items()]
    quarters = values.sparkSession.createDataFrame(found, "column string, q1 double, median double, q3 double")
    return sums.join(spread, "column").join(quarters, "column").select("column", F.col("count").alias("n"), "low", "high", "mean", "std", "q1", "median", "q3")


def semantic_types(values: DataFrame) -> DataFrame:
    """column, inferred_type, type_confidence, semantic_type, is_unique, nullable, unique_count, low, high."""
    number = as_number(F.col("value"))
    there = values.filter("not missing").groupBy("column").agg(F.min(number).alias("low"), F.max(number).alias("high"))
    votes = profile.type_vote(values).withColumnRenamed("confidence", "type_confidence")
    joined = profile.counts(values).join(votes, "column", "left").join(there, "column", "left")
    kind = profile.semantic_type(F.col("inferred_type"), F.col("unique_count"), F.col("count"), F.col("low"), F.col("high"))
    numeric = F.col("inferred_type").isin("integer", "float")
    bounds = [F.when(numeric, F.col(c)).alias(c) for c in ("low", "high")]
    return joined.select("column", "inferred_type", "type_confidence", kind.alias("semantic_type"), "is_unique", (F.col("null_count") > 0).alias("nullable"), "unique_count", *bounds)


def inferred_constraints(values: DataFrame) -> DataFrame:
    """column, kind (set, range, unique, not_null, pattern), low, high, pattern, confidence of what could be required."""
    t = semantic_types(values)
    none = F.lit(None).cast("string")

    def rule(when: Column, kind: str, sure: float) -> Column:
        low, high = (F.col(c) if kind == "range" else F.lit(None).cast("double") for c in ("low", "high"))
        return F.when(when, F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), none.alias("pattern"), F.lit(sure).alias("confidence")))

    few = F.col("semantic_type").isin("categorical", "binary") & (F.col("unique_count") <= FEW)
    rules = F.array_compact(F.array(rule(few, "set", SET), rule(F.col("low").isNotNull(), "range", RANGE), rule(F.col("is_unique"), "unique", UNIQUE), rule(~F.col("nullable"), "not_null", NOT_NULL)))
    found = t.select("column", F.inline(rules))
    mined = value_patterns(values).select("column", F.lit("pattern").alias("kind"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "pattern", F.col("score").alias("confidence"))
    return found.unionByName(mined)


def roles(values: DataFrame) -> DataFrame:
    """column, role, role_confidence: by the column's name, else by the form of its values, else unknown."""
    by_form = F.create_map(*[F.lit(x) for kv in FORMAT_ROLES.items() for x in kv])[F.col("format")]
    named = profile.role_of(F.col("column"))
    joined = values.select("column").distinct().join(profile.format_vote(values).select("column", "format"), "column", "left")
    sure = F.when(named != "unknown", BY_NAME).when(by_form.isNotNull(), BY_FORMAT).otherwise(0.0)
    return joined.select("column", F.when(named != "unknown", named).otherwise(F.coalesce(by_form, F.lit("unknown"))).alias("role"), sure.alias("role_confidence"))


def fused(values: DataFrame) -> DataFrame:
    """column, inferred_type, semantic_type, role, nullable, is_unique, constraints (kinds of sufficient confidence),
    confidence, sources: what statistics and names say together.  Everything after the dictionary has a row a column."""
    mined = value_patterns(values).select("column", "score")
    kept = inferred_constraints(values).filter(F.col("confidence") >= KEPT_CONSTRAINT).groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("constraints"))
    joined = semantic_types(values).join(roles(values), "column").join(mined, "column", "left").join(kept, "column", "left")
    semantic = (F.col("role_confidence") + F.coalesce("score", F.lit(0.0))) / 2
    by_unique = (semantic <= ROLE_FROM) & F.col("is_unique") & ~F.col("nullable")
    confidence = (F.coalesce("type_confidence", F.lit(0.0)) * STATISTICAL + semantic * SEMANTIC) / (STATISTICAL + SEMANTIC)
    return joined.select(
        "column", "inferred_type", "semantic_type", F.when(by_unique, "identifier").otherwise(F.col("role")).alias("role"), "nullable", "is_unique",
        F.coalesce("constraints", F.lit("")).alias("constraints"), F.round(confidence, 4).alias("confidence"),
        F.when(semantic > SOURCE_FROM, "statistical,semantic").otherwise("statistical").alias("sources"),
    )


def far_values(df: DataFrame, column: str, width: float = 1.5, limit: float = 3.0) -> DataFrame:
    """column, n_iqr, n_z, occurrences: values outside the quartiles by `width` ranges, by more than `limit` standard
    deviations, or either.  Quartiles are order statistics; one row of statistics meets the table."""
    v = F.col(f"`{column}`").cast("double")
    q1, _, q3 = ranks.quartiles(df, column) or (0.0, 0.0, 0.0)
    wide = (q3 - q1) * width
    far = (v < q1 - wide) | (v > q3 + wide)
    stats = df.agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
    odd = F.when(F.col("s") > 0, F.abs(v - F.col("m")) / F.col("s") > limit).otherwise(F.lit(False))
    return df.crossJoin(F.broadcast(stats)).agg(F.count_if(far).alias("n_iqr"), F.count_if(odd).alias("n_z"), F.count_if(far | odd).alias("occurrences")).select(F.lit(column).alias("column"), "n_iqr", "n_z", "occurrences")
