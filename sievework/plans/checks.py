"""The checks of an analysis as a registry, run over one grouped pass of the rows.

A check of values says which columns it applies to, which values it is about, and, where several values are compared, by
which key they are grouped.  A check of rows gives a condition, or a key by which rows are grouped.  The analysis turns
rows into entries, a cell for each column and one for each check of rows, and groups all of them at once; every check of
values then reads that dictionary in one more pass.  Users add checks of their own to CHECKS and ROW_CHECKS.

What a check learns of a column is a Tally: the number of its groups, the rows in all of them, in the largest, in groups
with more than one spelling (of checks of rows: the number of groups in which `other` differs), and beyond the first row of
each group.  Findings turn it into occurrences and a severity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import MISSING_PATTERNS, any_contains, as_number, date_format, parses_as, shape, trim
from sievework.operators import samples
from sievework.operators import validators as V

# What columns' names say about the checks that apply.
DATE_PAIRS = [(["start_date", "start", "begin", "enrollment"], ["end_date", "end", "finish", "completion"]), (["birth", "dob", "date_of_birth"], ["death", "dod", "date_of_death"]), (["admission", "admit"], ["discharge"]), (["diagnosis_date", "dx_date"], ["treatment_date", "tx_date"])]
ID_PARTS = ["id", "index", "uuid", "guid", "key"]
ID_NAMES = ["sample_id", "id", "patient_id", "subject_id"]
SET_VALUES = 20



class Tally(NamedTuple):
    groups: int = 0
    total: int = 0
    most: int = 0
    spelled: int = 0
    repeated: int = 0


@dataclass
class Table:
    """What is known of a table when checks are chosen: its columns and identifiers by name, then its profile (a row for
    each column), expected sets and bounds."""

    columns: list[str]
    ids: list[str]
    identifier: str | None
    profile: dict[str, Any] = field(default_factory=dict)
    total: int = 0
    sets: dict[str, list[str]] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def of_type(self, *types: str) -> list[str]:
        return [c for c in self.columns if c in self.profile and (self.profile[c].inferred_type or "string") in types]

    def share(self, n: int) -> float:
        return n * 100.0 / max(self.total, 1)

    def there(self, column: str) -> int:
        p = self.profile[column]
        return p["count"] - p.null_count


Found = Iterable[tuple[int, str]]


@dataclass(frozen=True)
class Check:
    """A check of values.  `columns` gives the columns it applies to, each with parameters; `bad` and `key` are expressions
    over column, value, text (trimmed), small (trimmed, in small letters), n and a column's parameters."""

    name: str
    detector: str
    kind: str
    columns: Callable[[Table], dict[str, Any]]
    bad: Callable[[Any], Column]
    findings: Callable[[Tally, Table, str], Found]
    key: Callable[[Any], Column] = lambda _: F.lit("")
    spelling: str = "text"
    confidence: float | None = None
    part: str | None = None
    missing: bool = False
    percentage: float | None = None
    #: Which groups it is about: those of more than one spelling, of more than one row, or all but the largest.
    group: str | None = None


@dataclass(frozen=True)
class RowCheck:
    """A check of rows: `bad` is a condition, or `key` groups rows and `other` is what may differ within a group.  `columns`
    gives the label under which it reports, and the columns that it reads, for each way in which it applies."""

    name: str
    detector: str
    kind: str
    columns: Callable[[Table], dict[str, list[str]]]
    findings: Callable[[Tally, Table, str], Found]
    bad: Callable[..., Column] | None = None
    key: Callable[..., Column] | None = None
    other: Callable[..., Column] | None = None
    confidence: float | None = None


def _some(severity: str) -> Callable[[Tally, Table, str], Found]:
    return lambda t, table, c: [(t.total, severity)]


def _rule(measure: str, severity: str) -> Callable[[Tally, Table, str], Found]:
    return lambda t, table, c: [(getattr(t, measure), severity)]


def _each(columns: Iterable[str]) -> dict[str, None]:
    return dict.fromkeys(columns)


def _limit(name: str) -> float | None:
    """90 for a latitude, 180 for a longitude."""
    n = name.lower()
    if n.endswith("name") or any(p in n for p in ("_name", "lat_lon", "latlon", "coordinates")):
        return None
    if n in ("lat", "latitude") or "_lat" in n or n.startswith("lat_"):
        return 90
    return 180 if n in ("lon", "lng", "long", "longitude") or "_lon" in n or "_lng" in n or n.startswith(("lon_", "lng_")) else None


def _combined(name: str) -> bool:
    """Whether a column holds latitude and longitude as one text."""
    n = name.lower()
    return not n.endswith("name") and "_name" not in n and (any(p in n for p in ("lat_lon", "latlon", "coordinates")) or n in ("geo_loc", "location"))


def find(columns: list[str], parts: list[str]) -> str | None:
    """The first column whose name holds the earliest part, so that 'height' is not taken for the 'ht' of 'weight'."""
    return next((c for p in parts for c in columns if p in c.lower()), None)


def identifier_of(columns: list[str], ids: list[str]) -> str | None:
    named = [c for c in columns if c.lower() in ID_NAMES]
    first = [c for c in columns[:1] if any(p in c.lower() for p in ("id", "sample", "subject"))]
    return next(iter([*ids, *named, *first]), None)


def _patterns(table: Table) -> dict[str, str]:
    return {c: p for c in table.of_type("string") for parts, p in V.NAME_PATTERNS[::-1] if any_contains(c, parts)}


def _broken(t: Tally, table: Table, c: str) -> Found:
    there = table.there(c)
    return [(t.total, "warning" if t.total * 100.0 / there > 10 else "info")] if t.total * 100.0 / max(there, 1) <= 50 else []


def _minority(t: Tally, table: Table, c: str) -> Found:
    return [(t.total - t.most, "warning")] if t.groups > 1 and t.most >= 0.7 * t.total else []


def _numeric(table: Table) -> dict[str, tuple[float, float]]:
    return {c: (table.profile[c].low, table.profile[c].high) for c in table.of_type("integer", "float") if table.profile[c].low is not None}


def _outside(bounds: tuple[float, float]) -> Column:
    v = as_number(F.col("text"))
    return (v < bounds[0]) | (v > bounds[1])


def _in(values: list[str], small: bool = False) -> Column:
    return F.col("small").isin([v.lower() for v in values]) if small else F.col("text").isin(values)


def _canonical() -> Column:
    """The first group of synonyms that has a text, or null."""
    terms: dict[str, str] = {}
    for group in V.SYNONYMS:
        for term in group:
            terms.setdefault(term.lower(), group[0])
    quoted = lambda t: '"' + t + '"'
    return F.expr(f"CASE WHEN small IN ({', '.join(map(quoted, terms))}) THEN map({', '.join(quoted(x) for kv in terms.items() for x in kv)})[small] END")


def _misplaced(part: str) -> Column:
    lat, lon, _, two = V.pair_of_degrees(F.col("text"))
    known = F.coalesce(lat.isNotNull() & lon.isNotNull() & two, F.lit(False))
    wide, far = F.abs(lat) > 90, F.abs(lon) > 180
    bad = {"out": known & (wide | far), "mixed": known, "swapped": known & wide & (F.abs(lat) <= 180) & (F.abs(lon) <= 90), "unread": ~known}[part]
    return ~F.col("small").isin(V.NO_PLACE) & bad


def _place(part: str, kind: str, severity: str, confidence: float | None = None) -> Check:
    """One of the things that a column of combined coordinates may have wrong."""
    return Check(f"coordinates_{part}", "coordinate_validator", kind, lambda t: _each(c for c in t.columns if _combined(c)), lambda _: _misplaced(part), _some(severity), confidence=confidence)


CHECKS: list[Check] = [
    Check("negative", "statistical_outlier_validator", "outlier", lambda t: _each(c for c in t.columns if any_contains(c, V.NON_NEGATIVE)), lambda _: as_number(F.col("text")) < 0, _some("error"), confidence=V.NEGATIVE),
    Check("missing_pattern", "missing_pattern_validator", "missing_pattern", lambda t: _each(t.columns), lambda _: F.col("small").isin(MISSING_PATTERNS), lambda t, table, c: [(t.total, "warning")] if t.total >= 2 else [], part="small", missing=True),
    Check("case_variant", "case_variant_validator", "inconsistency", lambda t: _each(t.of_type("string")), lambda _: F.lit(True), _rule("spelled", "warning"), lambda _: F.col("small"), group="spelled"),
    Check("synonym", "semantic_equivalence_validator", "inconsistency", lambda t: _each(t.of_type("string")), lambda _: _canonical().isNotNull(), _rule("spelled", "warning"), lambda _: _canonical(), "value", group="spelled"),
    Check("title_case", "title_case_validator", "inconsistency", lambda t: _each(c for c in t.columns if any_contains(c, V.TITLE_NAMES)), lambda _: F.col("value").rlike("^[a-z]"), _some("info")),
    Check("name_pattern", "regex_pattern_validator", "pattern_violation", _patterns, lambda p: ~F.col("text").rlike(p), _broken),
    Check("id_shape", "regex_pattern_validator", "inconsistency", lambda t: _each(c for c in t.ids if c in t.profile), lambda _: F.lit(True), _minority, lambda _: shape(F.col("text")), confidence=V.ID_SHAPE, group="minority"),
    Check("identifier", "identifier_duplicate_validator", "duplicate", lambda t: _each(c for c in t.ids if c in t.profile and not t.profile[c].is_unique), lambda _: F.lit(True), _rule("repeated", "error"), lambda _: F.col("text"), group="repeated"),
    Check("type", "type_validator", "type_mismatch", lambda t: {c: k for k in ("integer", "float", "boolean") for c in t.of_type(k)}, lambda kind: ~parses_as(F.col("value"), F.lit(kind)), lambda t, table, c: [(t.total, "error" if t.total * 100.0 / table.total > 10 else "warning")]),
    Check("range", "range_validator", "outlier", _numeric, _outside, _some("info")),
    Check("quartile", "statistical_outlier_validator", "outlier", lambda t: t.bounds, _outside, lambda t, table, c: [(t.total, "warning" if t.total > 1 else "info")]),
    Check("set", "set_validator", "constraint_violation", lambda t: t.sets, lambda s: ~_in(s), _some("warning")),
    Check("set_case", "consistency_validator", "inconsistency", lambda t: t.sets, lambda s: ~_in(s) & _in(s, True), _rule("groups", "warning"), lambda _: F.col("text")),
    Check("boolean", "consistency_validator", "inconsistency", lambda t: _each(t.of_type("boolean")), lambda _: F.col("text") != "", lambda t, table, c: [(t.groups, "warning")] if t.groups > 2 else [], lambda _: F.col("text"), confidence=0.92, missing=True),
    Check("date_format", "date_format_validator", "inconsistency", lambda t: _each(t.of_type("date")), lambda _: date_format(F.col("text")).isNotNull(), lambda t, table, c: [(t.total, "warning")] if t.groups > 1 else [], lambda _: date_format(F.col("text")), percentage=100.0),
    Check("coordinate", "coordinate_validator", "outlier", lambda t: {c: limit for c in t.columns if (limit := _limit(c))}, lambda limit: F.abs(V.signed_degrees(F.col("text"))) > limit, _some("error")),
    _place("out", "outlier", "error"),
    _place("swapped", "inconsistency", "warning", V.SWAPPED_COORDINATES),
    _place("unread", "pattern_violation", "warning", V.UNREAD_COORDINATES),
    replace(_place("mixed", "inconsistency", "warning", V.MIXED_COORDINATES), key=lambda _: V.pair_of_degrees(F.col("text"))[2].cast("string"), findings=lambda t, table, c: [(t.total, "warning")] if t.groups > 1 else []),
]


def _pairs(*parts: list[str], label: str | None = None) -> Callable[[Table], dict[str, list[str]]]:
    """The columns that have all these parts in their names, under their names or the name of the first."""

    def columns(table: Table) -> dict[str, list[str]]:
        own = [find(table.columns, p) for p in parts]
        if None in own or len(set(own)) != len(own):
            return {}
        return {own[0] if label == "first" else f"{own[0]} vs {own[1]}": own}

    return columns


def _digest(columns: list[str]) -> Column:
    return F.sha2(V.row_key(columns), 256)


def _content(table: Table) -> list[str]:
    return [c for c in table.columns if not any(p in c.lower() for p in ID_PARTS)]


def _small(column: str) -> Column:
    return F.lower(trim(F.col(f"`{column}`")))


ROW_CHECKS: list[RowCheck] = [
    *[RowCheck(f"late_start_{k}", "cross_column_validator", "cross_column_inconsistency", _pairs(*pair), _some("warning"), V.starts_late) for k, pair in enumerate(DATE_PAIRS)],
    RowCheck("bmi", "cross_column_validator", "cross_column_inconsistency", _pairs(["bmi"], ["weight", "wt"], ["height", "ht"], label="first"), _some("warning"), V.bmi_is_off, confidence=V.BMI),
    RowCheck("pregnant_male", "cross_column_validator", "cross_column_inconsistency", _pairs(["sex", "gender"], ["pregnant", "pregnancy"]), _some("error"), samples.is_pregnant_male, confidence=V.PREGNANT_MALE),
    RowCheck("young_patient", "cross_column_validator", "cross_column_inconsistency", _pairs(["age"], ["diagnosis", "dx", "condition"]), _some("warning"), samples.is_young_patient, confidence=V.YOUNG_PATIENT),
    RowCheck("same_row", "duplicate_row_validator", "duplicate", lambda t: {"_table": t.columns}, _rule("repeated", "error"), key=lambda *columns: _digest(columns)),
    RowCheck("near_row", "duplicate_row_validator", "duplicate", lambda t: {"_table": [t.identifier, *_content(t)]} if t.identifier and _content(t) else {}, _rule("spelled", "warning"), key=lambda _, *content: _digest(content), other=lambda own, *_: _small(own), confidence=V.NEAR_ROW),
    RowCheck("id_conflict", "duplicate_row_validator", "duplicate", lambda t: {t.identifier: [t.identifier, *_content(t)]} if t.identifier and _content(t) else {}, _rule("spelled", "error"), key=lambda own, *_: F.sha2(_small(own), 256), other=lambda _, *content: _digest(content), confidence=V.ID_CONFLICT),
]


def entries(rows: DataFrame, table: Table, row_checks: list[RowCheck], cells: bool = True) -> DataFrame:
    """_row_id, check, column, value and other: a cell for each column (check is empty) and one for each check of rows that
    the row has something for."""
    none = F.lit(None).cast("string")
    entry = lambda check, column, value, other=none: F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), value.alias("value"), other.alias("other"))
    own_cells = [entry("", c, F.col(f"`{c}`")) for c in table.columns if cells]
    whole = [entry(k.name, label, k.key(*own), k.other(*own) if k.other else none) for k in row_checks if k.key for label, own in k.columns(table).items()]
    held = [F.when(k.bad(*own), entry(k.name, label, F.lit(""))) for k in row_checks if k.bad for label, own in k.columns(table).items()]
    none_at_all = [] if own_cells or whole or held else [F.lit(None).cast("struct<check:string,column:string,value:string,other:string>")]
    return rows.select("_row_id", F.explode(F.array(*own_cells, *whole, *held, *none_at_all)).alias("e")).filter("e is not null").select("_row_id", "e.*")


def asked_of_rows(rows: DataFrame, table: Table, row_checks: list[RowCheck]) -> DataFrame:
    """The entries of checks of rows alone."""
    return entries(rows, table, row_checks, cells=False)


def _differs(text: str) -> Column:
    """Whether a group has more than one text: the ends of two hashes of it, as the ends of texts themselves would need a
    sort."""
    names = [F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))]
    return (F.min(names[0]) != F.max(names[0])) | (F.min(names[1]) != F.max(names[1]))


def grouped(found: DataFrame) -> DataFrame:
    """check, column, value, n, first_row, differs: one row for each distinct text of each column and key of each check."""
    return found.groupBy("check", "column", "value").agg(F.count("*").alias("n"), F.min("_row_id").alias("first_row"), _differs("other").alias("differs"))


def spread(values: DataFrame, table: Table, checks: list[Check]) -> DataFrame:
    """check, column, key, spelling, n and first_row for each value that a check is about."""
    cells = values.withColumn("text", trim(F.col("value"))).withColumn("small", F.lower("text"))
    asked = []
    for check in checks:
        # Columns with equal parameters share an expression.
        alike: list[tuple[Any, list[str]]] = []
        for c, given in check.columns(table).items():
            same = next((names for g, names in alike if g == given), None)
            alike.append((given, [c])) if same is None else same.append(c)
        for given, names in alike:
            mine = F.col("column").isin(names) if len(names) < len(table.columns) else F.lit(True)
            about = mine & check.bad(given) if check.missing else mine & ~F.col("missing") & check.bad(given)
            label = F.col("column") if check.part is None else F.concat_ws("=", "column", check.part)
            asked.append(F.when(about, F.struct(F.lit(check.name).alias("check"), label.alias("label"), check.key(given).alias("key"), F.col(check.spelling).alias("spelling"))))
    if not asked:
        asked = [F.lit(None).cast("struct<check:string,label:string,key:string,spelling:string>")]
    return cells.select("column", "value", "n", "first_row", F.explode(F.array(*asked)).alias("e")).filter("e is not null").select("e.*", "column", "value", "n", "first_row")


def groups_of(spreaded: DataFrame) -> DataFrame:
    """check, label, key, total, n_values, spelled, first_row: the groups that values make under each check."""
    return spreaded.groupBy("check", "label", "key").agg(F.sum("n").alias("total"), F.count("*").alias("n_values"), _differs("spelling").alias("spelled"), F.min("first_row").alias("first_row"))


def tallies(groups: DataFrame) -> DataFrame:
    """check, label and the Tally of each."""
    n = F.col("total")
    return groups.groupBy("check", "label").agg(F.count("*").alias("groups"), F.sum(n).alias("total"), F.max(n).alias("most"), F.sum(F.when(F.col("spelled"), n).otherwise(0)).alias("spelled"), F.sum(n - 1).alias("repeated"))
