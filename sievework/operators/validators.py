"""Value and row checks.  Each gives observations: type, severity, column, detector, occurrences, percentage.

Value checks run on the value dictionary, so their cost follows the number of distinct texts; row checks shuffle on
what they group by.  Confidences are those of CONFIDENCE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import MISSING_PATTERNS, any_contains, as_number, date_format, is_missing, parses_as, shape, trim
from sievework.operators import ranks
from sievework.operators.typos import close_pairs

# Fixed values.
CONFIDENCE = {"type_validator": 0.90, "range_validator": 0.85, "set_validator": 0.85, "uniqueness_validator": 0.95, "identifier_duplicate_validator": 0.95, "statistical_outlier_validator": 0.85, "completeness_validator": 0.95, "consistency_validator": 0.88, "case_variant_validator": 0.90, "typo_validator": 0.75, "semantic_equivalence_validator": 0.85, "date_format_validator": 0.90, "missing_pattern_validator": 0.88, "regex_pattern_validator": 0.75, "cross_column_validator": 0.85, "title_case_validator": 0.85, "coordinate_validator": 0.95, "duplicate_row_validator": 0.98, "mixs_compliance": 0.95}
# Checks that are more or less certain than their detector.
NEGATIVE, ID_SHAPE, BMI, PREGNANT_MALE, YOUNG_PATIENT, NEAR_ROW, ID_CONFLICT = 0.95, 0.80, 0.70, 0.95, 0.70, 0.85, 0.95
MIXED_COORDINATES, SWAPPED_COORDINATES, UNREAD_COORDINATES = 0.85, 0.75, 0.80
NO_PLACE = ["missing", "not collected", "not applicable"]
NON_NEGATIVE = ["age", "weight", "height", "bmi", "count", "reads", "read_count", "concentration", "conc", "length", "size", "distance", "duration", "price", "cost", "amount", "quantity", "score", "rating"]
TITLE_NAMES = ["treatment", "drug", "medication", "medicine", "therapy", "rx"]
NAME_PATTERNS = [(["email", "e_mail"], r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"), (["url", "website", "link"], r"^https?://[^\s]+\z"), (["phone", "tel", "mobile"], r"^\+?[0-9\s\-\(\)]{7,}\z"), (["zip", "postal"], r"^[0-9]{5}(-[0-9]{4})?\z")]
SYNONYMS = [
    ["CD", "Crohn's", "Crohns", "Crohn's Disease", "Crohn Disease"], ["UC", "Ulcerative Colitis"], ["IBD", "Inflammatory Bowel Disease"],
    ["T2D", "Type 2 Diabetes", "Type II Diabetes", "Diabetes Mellitus Type 2"], ["T1D", "Type 1 Diabetes", "Type I Diabetes", "Diabetes Mellitus Type 1"],
    ["HTN", "Hypertension", "High Blood Pressure"], ["MI", "Myocardial Infarction", "Heart Attack"], ["CVD", "Cardiovascular Disease"],
    ["COPD", "Chronic Obstructive Pulmonary Disease"], ["CKD", "Chronic Kidney Disease"], ["HF", "Heart Failure", "CHF", "Congestive Heart Failure"],
    ["stool", "feces", "fecal", "faeces", "faecal"], ["gut", "intestine", "intestinal", "GI", "gastrointestinal"], ["blood", "serum", "plasma"],
    ["urine", "urinary"], ["saliva", "oral", "buccal"], ["biopsy", "tissue"], ["M", "Male", "man"], ["F", "Female", "woman"],
    ["yes", "Y", "true", "1"], ["no", "N", "false", "0"], ["control", "healthy", "normal"], ["treated", "treatment", "drug"], ["placebo", "vehicle"],
    ["responder", "response", "R"], ["non-responder", "nonresponder", "NR", "no response"], ["partial", "partial response", "PR"],
    ["mild", "low"], ["moderate", "medium"], ["severe", "high"], ["active", "flare"], ["inactive", "remission", "quiescent"],
    ["never", "non-smoker", "nonsmoker"], ["former", "ex-smoker", "past"], ["current", "smoker", "active smoker"],
    ["chemotherapy", "chemo"], ["radiation", "radiotherapy", "RT"], ["surgery", "surgical"], ["immunotherapy", "immuno"],
]


def observation(found: DataFrame, kind: str, severity: Column | str, detector: str, total: int, column: Column | None = None, occurrences: str = "occurrences", confidence: float | None = None) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    share = F.round(F.col(occurrences) * 100.0 / max(total, 1), 4)
    return found.select(F.lit(kind).alias("type"), level.alias("severity"), (F.col("column") if column is None else column).alias("column"), F.lit(detector).alias("detector"), F.lit(CONFIDENCE[detector] if confidence is None else confidence).alias("confidence"), F.col(occurrences).cast("long").alias("occurrences"), share.alias("percentage"))


def _some(df: DataFrame) -> DataFrame:
    return df.filter("occurrences > 0")


def type_mismatch(values: DataFrame, types: dict[str, str], total: int) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[F.col("column")]
    bad = values.filter(~F.col("missing") & ~parses_as(F.col("value"), kind))
    found = bad.groupBy("column").agg(F.sum("n").alias("occurrences"))
    return observation(found, "type_mismatch", F.when(F.col("occurrences") * 100.0 / total > 10, "error").otherwise("warning"), "type_validator", total)


def out_of_range(values: DataFrame, ranges: dict[str, tuple[float, float]], total: int) -> DataFrame:
    low, high = (F.create_map(*[F.lit(x) for c, r in ranges.items() for x in (c, float(r[k]))])[F.col("column")] for k in (0, 1))
    v = as_number(trim(F.col("value")))
    found = values.filter(~F.col("missing") & ((v < low) | (v > high))).groupBy("column").agg(F.sum("n").alias("occurrences"))
    return observation(found, "outlier", "info", "range_validator", total)


def not_in_set(values: DataFrame, allowed: dict[str, list[str]], total: int) -> DataFrame:
    sets = F.create_map(*[x for c, a in allowed.items() for x in (F.lit(c), F.array(*map(F.lit, a)))])[F.col("column")]
    found = values.filter(~F.col("missing") & ~F.array_contains(sets, trim(F.col("value")))).groupBy("column").agg(F.sum("n").alias("occurrences"))
    return observation(found, "constraint_violation", "warning", "set_validator", total)


def not_unique(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    found = values.filter(F.col("column").isin(columns) & ~F.col("missing") & (F.col("n") > 1)).groupBy("column").agg(F.sum(F.col("n") - 1).alias("occurrences"))
    return observation(found, "duplicate", "error", "uniqueness_validator", total)


def duplicate_identifiers(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    trimmed = values.filter(F.col("column").isin(columns) & ~F.col("missing")).groupBy("column", trim(F.col("value")).alias("v")).agg(F.sum("n").alias("n"))
    found = trimmed.filter("n > 1").groupBy("column").agg(F.sum(F.col("n") - 1).alias("occurrences"))
    return observation(found, "duplicate", "error", "identifier_duplicate_validator", total)


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """One row: quartiles, bounds, number of values outside.  Rounds of histograms find the quartiles, one pass counts."""
    q1, median, q3 = ranks.quartiles(df, column) or (None, None, None)
    v = F.col(f"`{column}`").cast("double")
    outside = F.lit(False) if q1 is None else (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
    given = [F.lit(x).cast("double").alias(name) for name, x in (("q1", q1), ("median", median), ("q3", q3))]
    return df.agg(F.count(v).alias("n"), F.count_if(outside).alias("occurrences")).select(F.lit(column).alias("column"), *given, "n", "occurrences")


def iqr_bounds(values: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Of each numeric column what lies 1.5 ranges of the quartiles outside them; the numbers are not trimmed."""
    numbers = values.filter(~F.col("missing") & F.col("column").isin(columns)).select("column", as_number(F.col("value")).alias("v"), "n")
    return {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, _, q3) in ranks.order_statistics(numbers).items()}


def iqr_values(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    """Outliers of the numeric columns of a value dictionary, all columns at once."""
    found = out_of_range(values, iqr_bounds(values, columns) or {"": (0, 0)}, total)
    return found.withColumns({"severity": F.when(F.col("occurrences") > 1, "warning").otherwise("info"), "detector": F.lit("statistical_outlier_validator"), "confidence": F.lit(CONFIDENCE["statistical_outlier_validator"])})


def negative_values(values: DataFrame, total: int) -> DataFrame:
    named = F.col("column").rlike("(?i)" + "|".join(NON_NEGATIVE))
    found = values.filter(named & ~F.col("missing") & (as_number(trim(F.col("value"))) < 0)).groupBy("column").agg(F.sum("n").alias("occurrences"))
    return observation(found, "outlier", "error", "statistical_outlier_validator", total, confidence=NEGATIVE)


def completeness(values: DataFrame, total: int) -> DataFrame:
    found = values.filter("missing").groupBy("column").agg(F.sum("n").alias("occurrences")).filter(F.col("occurrences") * 100.0 / total >= 5)
    return observation(found, "completeness", F.when(F.col("occurrences") * 100.0 / total >= 20, "error").otherwise("warning"), "completeness_validator", total)


def row_completeness(rows: DataFrame, columns: list[str], total: int) -> DataFrame:
    """completeness, counted in one pass over the rows: nothing but a row a column is shuffled, however many texts differ."""
    counted = rows.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(is_missing(F.col(f"`{c}`"))).alias("occurrences")) for c in columns]).alias("c")).select(F.inline("c"))
    found = counted.filter(F.col("occurrences") * 100.0 / max(total, 1) >= 5)
    return observation(found, "completeness", F.when(F.col("occurrences") * 100.0 / max(total, 1) >= 20, "error").otherwise("warning"), "completeness_validator", total)


def inconsistent_case(values: DataFrame, allowed: dict[str, list[str]], total: int) -> DataFrame:
    """Distinct spellings that are in the expected set but for their case."""
    exact = F.create_map(*[x for c, a in allowed.items() for x in (F.lit(c), F.array(*map(F.lit, a)))])[F.col("column")]
    loose = F.create_map(*[x for c, a in allowed.items() for x in (F.lit(c), F.array(*[F.lit(v.lower()) for v in a]))])[F.col("column")]
    t = trim(F.col("value"))
    odd = values.filter(~F.col("missing") & ~F.array_contains(exact, t) & F.array_contains(loose, F.lower(t)))
    found = odd.groupBy("column").agg(F.count_distinct(t).alias("occurrences"))
    return observation(found, "inconsistency", "warning", "consistency_validator", total)


def case_variants(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    t = trim(F.col("value"))
    groups = values.filter(F.col("column").isin(columns) & ~F.col("missing")).groupBy("column", F.lower(t).alias("g")).agg(F.count_distinct(t).alias("spellings"), F.sum("n").alias("n"))
    found = groups.filter("spellings > 1").groupBy("column").agg(F.sum("n").alias("occurrences"))
    return observation(found, "inconsistency", "warning", "case_variant_validator", total)


def typo_pairs(values: DataFrame, columns: list[str]) -> DataFrame:
    """column, typo, suggestion, n: texts seen once that are at most two edits from a frequent one (the most frequent, then
    the earliest).  Candidates meet in an index of deletions."""
    there = values.filter(F.col("column").isin(columns) & ~F.col("missing")).select("column", F.col("value").alias("v"), "n", "first_row").filter(F.octet_length("v") >= 4)
    rare = there.filter("n = 1").select("column", F.col("v").alias("typo"))
    common = there.filter("n > 1").select("column", F.col("v").alias("suggestion"), "n", "first_row")
    # Only lengths within two of a frequent text's can hold a typo of it.
    sizes = common.select("column", F.explode(F.sequence(F.length("suggestion") - 2, F.length("suggestion") + 2)).alias("size")).distinct()
    perhaps = rare.withColumn("size", F.length("typo")).join(sizes, ["column", "size"], "left_semi").select("column", "typo")
    near = close_pairs(perhaps, common, "typo", "suggestion")
    best = near.filter((F.col("edits") > 0) & (F.col("edits") < F.floor(F.octet_length("typo") / 2))).groupBy("column", "typo").agg(F.max_by(F.struct("suggestion", "n"), F.struct("n", -F.col("first_row"))).alias("b"))
    return best.select("column", "typo", "b.suggestion", "b.n")


def typos(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    found = typo_pairs(values, columns).groupBy("column").agg(F.count("*").alias("occurrences"))
    return observation(found, "inconsistency", "warning", "typo_validator", total)


def synonym_frame(values: DataFrame) -> DataFrame:
    """term (in small letters), canonical: the first group that has a term wins."""
    terms: dict[str, str] = {}
    for group in SYNONYMS:
        for term in group:
            terms.setdefault(term.lower(), group[0])
    return values.sparkSession.createDataFrame(list(terms.items()), "term string, canonical string")


def synonyms(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    there = values.filter(F.col("column").isin(columns) & ~F.col("missing")).withColumn("term", F.lower(trim(F.col("value"))))
    joined = there.join(F.broadcast(synonym_frame(values)), "term")
    groups = joined.groupBy("column", "canonical").agg(F.count_distinct("value").alias("spellings"), F.sum("n").alias("n")).filter("spellings > 1")
    found = groups.groupBy("column").agg(F.sum("n").alias("occurrences"))
    return observation(found, "inconsistency", "warning", "semantic_equivalence_validator", total)


def date_formats(values: DataFrame, columns: list[str]) -> DataFrame:
    """column, format, n of date columns that are written in more than one way."""
    votes = values.filter(F.col("column").isin(columns) & ~F.col("missing")).groupBy("column", date_format(trim(F.col("value"))).alias("format")).agg(F.sum("n").alias("n")).filter("format is not null")
    mixed = votes.groupBy("column").agg(F.count("*").alias("k")).filter("k > 1").select("column")
    return votes.join(F.broadcast(mixed), "column")


def mixed_dates(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    """Date columns that are written in more than one way, with all their dates of a known format (100 % by rule)."""
    found = date_formats(values, columns).groupBy("column").agg(F.sum("n").alias("occurrences"))
    return observation(found, "inconsistency", "warning", "date_format_validator", total).withColumn("percentage", F.lit(100.0))


def missing_patterns(values: DataFrame, total: int) -> DataFrame:
    """One observation for each token that stands for a missing value and occurs at least twice in a column."""
    token = F.lower(trim(F.col("value")))
    found = values.filter(token.isin(MISSING_PATTERNS)).groupBy("column", token.alias("pattern")).agg(F.sum("n").alias("occurrences")).filter("occurrences >= 2")
    return observation(found.withColumn("column", F.concat_ws("=", "column", "pattern")), "missing_pattern", "warning", "missing_pattern_validator", total)


def name_patterns(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    """Values that break the pattern which their column's name promises; not reported where over half do."""
    pattern = None
    for name in columns:
        for parts, p in NAME_PATTERNS:
            if any_contains(name, parts):
                pattern = (F if pattern is None else pattern).when(F.col("column") == name, p)
                break
    if pattern is None:
        pattern = F.lit(None).cast("string")
    there = values.withColumn("pattern", pattern).filter(F.col("pattern").isNotNull() & ~F.col("missing"))
    found = there.groupBy("column").agg(F.sum(F.when(~F.call_function("rlike", trim(F.col("value")), F.col("pattern")), F.col("n")).otherwise(0)).alias("occurrences"), F.sum("n").alias("there"))
    share = F.col("occurrences") * 100.0 / F.col("there")
    return observation(_some(found).filter(share <= 50), "pattern_violation", F.when(share > 10, "warning").otherwise("info"), "regex_pattern_validator", total)


def id_shapes(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    """Identifiers that are not of the shape that at least 70 % have."""
    shapes = values.filter(F.col("column").isin(columns) & ~F.col("missing")).groupBy("column", shape(trim(F.col("value"))).alias("s")).agg(F.sum("n").alias("n"))
    votes = shapes.groupBy("column").agg(F.max("n").alias("most"), F.sum("n").alias("there"), F.count("*").alias("k"))
    found = votes.filter((F.col("k") > 1) & (F.col("most") >= 0.7 * F.col("there"))).withColumn("occurrences", F.col("there") - F.col("most"))
    return observation(found, "inconsistency", "warning", "regex_pattern_validator", total, confidence=ID_SHAPE)


def starts_late(start: str, end: str) -> Column:
    """Whether a start date is after the end date, as text; empty cells are left out."""

    def plain(c: str) -> Column:
        v = trim(F.col(f"`{c}`"))
        us = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z"
        return F.when(v.rlike(us), F.concat_ws("-", F.regexp_extract(v, us, 3), F.lpad(F.regexp_extract(v, us, 1), 2, "0"), F.lpad(F.regexp_extract(v, us, 2), 2, "0"))).otherwise(v)

    return (plain(start) != "") & (plain(end) != "") & (plain(start) > plain(end))


def late_start(rows: DataFrame, start: str, end: str, total: int) -> DataFrame:
    found = rows.agg(F.count_if(starts_late(start, end)).alias("occurrences")).withColumn("column", F.lit(f"{start} vs {end}"))
    return observation(_some(found), "cross_column_inconsistency", "warning", "cross_column_validator", total)


def bmi_is_off(bmi: str, weight: str, height: str) -> Column:
    """Whether a body mass index is over 10 % off; heights above 3 are in centimetres."""
    b, w, h = (as_number(trim(F.col(f"`{c}`"))) for c in (bmi, weight, height))
    metres = F.when(h > 3, h / 100).otherwise(h)
    own = w / (metres * metres)
    return (w > 0) & (h > 0) & (F.abs(b - own) / own > 0.1)


def wrong_bmi(rows: DataFrame, bmi: str, weight: str, height: str, total: int) -> DataFrame:
    found = rows.agg(F.count_if(bmi_is_off(bmi, weight, height)).alias("occurrences")).withColumn("column", F.lit(bmi))
    return observation(_some(found), "cross_column_inconsistency", "warning", "cross_column_validator", total, confidence=BMI)


def small_titles(values: DataFrame, columns: list[str], total: int) -> DataFrame:
    """Names of treatments that begin with a small letter."""
    named = [c for c in columns if any_contains(c, TITLE_NAMES)]
    found = values.filter(F.col("column").isin(named) & ~F.col("missing") & F.col("value").rlike("^[a-z]")).groupBy("column").agg(F.sum("n").alias("occurrences"))
    return observation(found, "inconsistency", "info", "title_case_validator", total)


def signed_degrees(v: Column) -> Column:
    """A number that may end in the letter of its direction, or null."""
    number = as_number(F.regexp_replace(v, r"(?i)\s*[nsew]\z", ""))
    return F.when(v.rlike(r"(?i)[sw]\z"), -number).otherwise(number)


def bad_coordinates(values: DataFrame, column: str, limit: float, total: int) -> DataFrame:
    """Values of a latitude (limit 90) or longitude (limit 180) column that are out of range."""
    found = values.filter((F.col("column") == column) & ~F.col("missing") & (F.abs(signed_degrees(trim(F.col("value")))) > limit)).groupBy("column").agg(F.sum("n").alias("occurrences"))
    return observation(found, "outlier", "error", "coordinate_validator", total)


def _degrees(c: Column) -> tuple[Column, Column]:
    """A number with or without a letter for its direction, or null; and degrees, minutes and seconds, or null."""
    plain = as_number(trim(F.regexp_replace(c, r"(?i)[nsew]\z", "")))
    decimal = F.when(c.rlike(r"(?i)[sw]\z"), -F.abs(plain)).when(c.rlike(r"(?i)[ne]\z"), F.abs(plain)).otherwise(plain)
    parts = F.filter(F.split(F.regexp_replace(c, "[°'\":]", " "), " "), lambda x: x != "")
    turned = as_number(F.get(parts, F.lit(0))) + as_number(F.get(parts, F.lit(1))) / 60 + F.coalesce(as_number(F.get(parts, F.lit(2))), F.lit(0.0)) / 3600
    signed = F.when(F.element_at(parts, -1).rlike("(?i)^[sw]"), -turned).otherwise(turned)
    return decimal, F.when(decimal.isNull() & (F.size(parts) >= 3), signed)


def pair_of_degrees(text: Column) -> tuple[Column, Column, Column, Column]:
    """Latitude and longitude of a text (null where they can't be read), whether one is written in degrees, minutes and
    seconds, and whether there are two parts."""
    pair = F.filter(F.split(text, r"[\p{IsWhite_Space},;]"), lambda x: x != "")
    (lat, lat_turned), (lon, lon_turned) = (_degrees(F.get(pair, F.lit(k))) for k in (0, 1))
    return F.coalesce(lat, lat_turned), F.coalesce(lon, lon_turned), lat_turned.isNotNull() | lon_turned.isNotNull(), F.size(pair) == 2


def combined_coordinates(values: DataFrame, column: str, total: int) -> DataFrame:
    """Places as one text of a latitude and a longitude: out of range, written in two ways, perhaps swapped, unreadable."""
    text = trim(F.col("value"))
    lat, lon, turned, two = pair_of_degrees(text)
    there = values.filter((F.col("column") == column) & ~F.col("missing") & ~F.lower(text).isin(NO_PLACE))
    read = there.select("column", "n", F.when(two, lat).alias("lat"), F.when(two, lon).alias("lon"), turned.alias("turned"))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    wide, far = F.abs("lat") > 90, F.abs("lon") > 180

    def rows(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)

    found = read.groupBy("column").agg(rows(known & (wide | far), "out"), rows(known, "known"), rows(known & F.col("turned"), "turned"), rows(known & wide & (F.abs("lat") <= 180) & (F.abs("lon") <= 90), "swapped"), rows(~known, "unread"))
    mixed = _some(found.select("column", F.when((F.col("turned") > 0) & (F.col("turned") < F.col("known")), F.col("known")).otherwise(0).alias("occurrences")))
    checks = [("out", "outlier", "error", None), ("swapped", "inconsistency", "warning", SWAPPED_COORDINATES), ("unread", "pattern_violation", "warning", UNREAD_COORDINATES)]
    out = observation(mixed, "inconsistency", "warning", "coordinate_validator", total, confidence=MIXED_COORDINATES)
    for name, kind, severity, confidence in checks:
        out = out.unionByName(observation(_some(found.select("column", F.col(name).alias("occurrences"))), kind, severity, "coordinate_validator", total, confidence=confidence))
    return out


def row_key(columns: list[str]) -> Column:
    return F.concat_ws("\0", *[F.lower(trim(F.col(f"`{c}`"))) for c in columns])


def duplicate_rows(rows: DataFrame, columns: list[str], total: int) -> DataFrame:
    groups = rows.groupBy(row_key(columns).alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    found = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("occurrences")).withColumn("column", F.lit("_table"))
    return observation(_some(found), "duplicate", "error", "duplicate_row_validator", total)


def near_duplicate_rows(rows: DataFrame, identifier: str, columns: list[str], total: int) -> DataFrame:
    """Groups of rows that agree on all but their identifiers."""
    groups = rows.groupBy(row_key(columns).alias("k")).agg(F.count_distinct(F.lower(trim(F.col(f"`{identifier}`")))).alias("ids")).filter("ids > 1")
    found = groups.agg(F.count("*").alias("occurrences")).withColumn("column", F.lit("_table"))
    return observation(_some(found), "duplicate", "warning", "duplicate_row_validator", total, confidence=NEAR_ROW)


def conflicting_identifiers(rows: DataFrame, identifier: str, columns: list[str], total: int) -> DataFrame:
    """Identifiers that stand for more than one content."""
    groups = rows.groupBy(F.lower(trim(F.col(f"`{identifier}`"))).alias("i")).agg(F.count_distinct(row_key(columns)).alias("contents")).filter("contents > 1")
    found = groups.agg(F.count("*").alias("occurrences")).withColumn("column", F.lit(identifier))
    return observation(_some(found), "duplicate", "error", "duplicate_row_validator", total, confidence=ID_CONFLICT)
