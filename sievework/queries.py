"""Registered queries of the data-quality engine, each with the SQL that checks it.

The tables are clean, so most queries run on a view with defects that follow from the keys; its text is the same SQL
for both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import accession, checklist, domain, inference, profile, samples, taxonomy, terms, values
from sievework.operators import validators as V
from sievework.operators.values import frequent, to_text, value_dictionary
from sievework.plans import apply, curation, decisions, evidence, explain, fallback, schema
from sievework.plans.analyze import Analysis, analyze, quality_report
from sievework.sources import delimited, quoted
from sievework.sources.shared import new_folder, staged
from sievework.streaming.values import windowed_rates

_Y, _M, _D = "CAST(year(o_orderdate) AS STRING)", "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')", "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
DIRTY_ORDERS = f"""
SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 13 = 0 THEN concat(' ', o_orderstatus) WHEN o_orderkey % 7 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 97 = 0 THEN '-5' WHEN o_orderkey % 89 = 0 THEN 'n/a' WHEN o_orderkey % 83 = 0 THEN 'abc' WHEN o_orderkey % 79 = 0 THEN '12.5' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS price,
  CASE o_orderkey % 5 WHEN 0 THEN concat({_M}, '/', {_D}, '/', {_Y}) WHEN 1 THEN concat({_Y}, '/', {_M}, '/', {_D}) WHEN 2 THEN concat({_M}, '-', {_D}, '-', {_Y}) WHEN 3 THEN concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', month(o_orderdate) * 3 - 2, 3), ' ', CAST(day(o_orderdate) AS STRING), ', ', {_Y}) ELSE concat({_Y}, '-', {_M}, '-', {_D}) END AS order_date,
  CASE WHEN o_orderkey % 19 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 1009 = 0 THEN concat(o_orderpriority, 'X') ELSE o_orderpriority END AS priority,
  CASE o_orderkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'Y' WHEN 2 THEN 'no' WHEN 3 THEN 'N' WHEN 4 THEN 'mild' ELSE 'low' END AS answer,
  CASE WHEN o_orderkey % 23 = 0 THEN 'not a link' ELSE concat('https://example.org/o/', CAST(o_orderkey AS STRING)) END AS url,
  CASE WHEN o_orderkey % 29 = 0 THEN 'aspirin' ELSE 'Aspirin' END AS treatment,
  CASE WHEN o_orderkey % 31 = 0 THEN '95.5' WHEN o_orderkey % 37 = 0 THEN '91 S' ELSE '45.25' END AS latitude,
  CASE WHEN o_orderkey % 41 = 0 THEN concat('X', CAST(100000 + o_custkey AS STRING)) ELSE concat('CUST-', CAST(100000 + o_custkey AS STRING)) END AS customer_code
FROM orders"""
TEXT = ["status", "price", "order_date", "priority", "answer", "url", "treatment", "latitude", "customer_code"]
DIRTY_PEOPLE = """
SELECT c_custkey AS person_id, CAST(50 + c_custkey % 50 AS STRING) AS weight,
  CASE WHEN c_custkey % 3 = 0 THEN '1.80' ELSE '180' END AS height,
  CASE WHEN c_custkey % 10 = 0 THEN '60' ELSE CAST(round((50 + c_custkey % 50) / 3.24, 2) AS STRING) END AS bmi,
  CASE c_custkey % 8 WHEN 0 THEN 'SAMN00000001' WHEN 1 THEN 'srr123456' WHEN 2 THEN 'PRJNA1234' WHEN 3 THEN 'NM_000014.5' WHEN 4 THEN 'P12345' WHEN 5 THEN '1ABC' WHEN 6 THEN 'bogus id' ELSE '12345' END AS accession,
  CASE c_custkey % 6 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'homo sapiens' WHEN 2 THEN 'E. coli' WHEN 3 THEN 'Mus muscullus' WHEN 4 THEN 'Unknown thing' ELSE 'Gallus gallus' END AS organism,
  CASE WHEN c_custkey % 9 = 0 THEN '01/02/2024' ELSE '2024-03-04' END AS start_date, CASE WHEN c_custkey % 7 = 0 THEN '2023-12-31' ELSE '2024-06-01' END AS end_date
FROM customer"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dirty(spark: SparkSession, sf_dir: str, sql: str = DIRTY_ORDERS, source: str = "orders", key: str = "order_id") -> DataFrame:
    return to_text(spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=_table(spark, sf_dir, source)), key)


def _values(columns: list[str], **where: str) -> Callable[[SparkSession, str], tuple[DataFrame, int]]:
    def build(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
        rows = _dirty(spark, sf_dir, **where)
        return value_dictionary(rows, columns), rows.count()

    return build


def _check(columns: list[str], check: Callable[[DataFrame, int], DataFrame], **where: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs a value check on a dirty view."""
    build = _values(columns, **where)
    return lambda spark, sf_dir: check(*build(spark, sf_dir))


def _rows(check: Callable[[DataFrame, int], DataFrame], **where: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _dirty(spark, sf_dir, **where)
        return check(rows, rows.count())

    return query


def _d(columns: list[str], dirty: str = DIRTY_ORDERS, key: str = "order_id") -> str:
    """The value dictionary in SQL: table d, and one-row table t with the number of rows."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v, {key} AS id FROM dirty" for c in columns)
    missing = "(trim(v) = '' OR lower(trim(v)) IN ('na','n/a','null','none','nil','.','-'))"
    return f"WITH dirty AS ({dirty}), t AS (SELECT count(*) AS total FROM dirty), d AS (SELECT c, v, count(*) AS n, min(id) AS first_row, {missing} AS missing FROM ({long}) GROUP BY c, v) "


# How sure each detector is, by hand and not from the code that is checked.
_SURE = {
    "type_validator": "0.9", "range_validator": "0.85", "set_validator": "0.85", "uniqueness_validator": "0.95", "identifier_duplicate_validator": "0.95",
    "statistical_outlier_validator": "0.85", "completeness_validator": "0.95", "consistency_validator": "0.88", "case_variant_validator": "0.9",
    "typo_validator": "0.75", "semantic_equivalence_validator": "0.85", "date_format_validator": "0.9", "missing_pattern_validator": "0.88",
    "regex_pattern_validator": "0.75", "cross_column_validator": "0.85", "title_case_validator": "0.85", "coordinate_validator": "0.95",
    "duplicate_row_validator": "0.98", "mixs_compliance": "0.95",
}


def _obs(kind: str, severity: str, detector: str, found: str, confidence: str | None = None) -> str:
    """An observation over a subquery with c (column) and o (occurrences)."""
    return f"SELECT '{kind}' AS type, {severity} AS severity, c AS \"column\", '{detector}' AS detector, CAST({confidence or _SURE[detector]} AS DOUBLE) AS confidence, CAST(o AS BIGINT) AS occurrences, round(o * CAST(100 AS DOUBLE) / total, 4) AS percentage FROM ({found}) f, t"


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"
_NUM = f"CASE WHEN regexp_matches(trim(v), '{_NUMBER}') THEN CAST(trim(v) AS DOUBLE) END"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# profiling
_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_add("profile_numeric", lambda s, d: profile.numeric_profile(_table(s, d, "lineitem"), _NUMERIC), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in _NUMERIC))
_add("value_dictionary", lambda s, d: value_dictionary(_dirty(s, d), TEXT[:2]), _d(TEXT[:2]) + 'SELECT c AS "column", v AS value, n, first_row, missing FROM d')
_add("profile_counts", lambda s, d: profile.counts(value_dictionary(_dirty(s, d), TEXT)), _d(TEXT) + 'SELECT c AS "column", CAST(sum(n) AS BIGINT) AS count, CAST(sum(CASE WHEN missing THEN n ELSE 0 END) AS BIGINT) AS null_count, CAST(count(*) FILTER (NOT missing) AS BIGINT) AS unique_count, count(*) FILTER (NOT missing) = sum(CASE WHEN missing THEN 0 ELSE n END) AND count(*) FILTER (NOT missing) > 0 AS is_unique FROM d GROUP BY c')
_add("profile_string", lambda s, d: profile.string_profile(value_dictionary(_dirty(s, d), TEXT)), _d(TEXT) + 'SELECT c AS "column", CAST(min(strlen(v)) AS INTEGER) AS min_length, CAST(max(strlen(v)) AS INTEGER) AS max_length, round(CAST(sum(strlen(v) * n) AS DOUBLE) / sum(n), 6) AS avg_length FROM d WHERE NOT missing GROUP BY c')
_add("value_counts_topk", lambda s, d: frequent(value_dictionary(_dirty(s, d), ["status", "priority"]), 5).select("column", "value", "n", F.col("rank").cast("long").alias("rank")), _d(["status", "priority"]) + 'SELECT c AS "column", v AS value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, first_row) AS rank FROM d) WHERE rank <= 5')
_TYPE = f"CASE WHEN lower(v) IN ('true','false','yes','no') THEN 'boolean' WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(v, '{_NUMBER}') THEN 'float' WHEN regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|^[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{2,4}}|^[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}') THEN CASE WHEN contains(v, ':') OR contains(v, 'T') THEN 'datetime' ELSE 'date' END ELSE 'string' END"
_add("type_vote", lambda s, d: profile.type_vote(value_dictionary(_dirty(s, d), TEXT)), _d(TEXT) + f", k AS (SELECT c, {_TYPE} AS t, sum(n) AS n FROM d WHERE NOT missing GROUP BY 1, 2), w AS (SELECT c, arg_max(t, n * 10 - list_position(['integer','float','boolean','date','datetime','string'], t)) AS t, max(n) AS n, sum(n) AS total, max(CASE WHEN t = 'float' THEN 1 ELSE 0 END) AS floats FROM k GROUP BY c) SELECT c AS \"column\", CASE WHEN t = 'integer' AND floats = 1 THEN 'float' ELSE t END AS inferred_type, round(CAST(n AS DOUBLE) / total * CASE WHEN t = 'integer' AND floats = 1 THEN CAST(0.95 AS DOUBLE) ELSE 1 END, 6) AS confidence FROM w")
_FORM = "CASE WHEN v LIKE 'https://%' THEN 'url' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'iso_date' WHEN regexp_matches(v, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') THEN 'us_date' WHEN regexp_matches(v, '^[0-9]{5}$') THEN 'zip_code' WHEN regexp_matches(v, '^CUST-[0-9]{6}') THEN 'sample_id' WHEN lower(v) IN ('yes', 'no', 'y', 'n', 'f') THEN 'boolean' END"
_add("format_vote", lambda s, d: profile.format_vote(value_dictionary(_dirty(s, d), TEXT)), _d(TEXT) + f", k AS (SELECT c, {_FORM} AS f, sum(n) AS n FROM d WHERE NOT missing GROUP BY 1, 2), u AS (SELECT c, sum(n) AS total FROM k GROUP BY c) SELECT k.c AS \"column\", arg_max(f, k.n) AS format, CAST(max(k.n) AS BIGINT) AS n FROM k JOIN u USING (c) WHERE f IS NOT NULL GROUP BY k.c, total HAVING max(k.n) >= floor(total * 0.8)")
_ROLE = "CASE \"column\" WHEN 'status' THEN 'grouping' WHEN 'treatment' THEN 'grouping' WHEN 'order_date' THEN 'metadata' ELSE 'unknown' END"
_add("column_roles", lambda s, d: profile.counts(value_dictionary(_dirty(s, d), TEXT)).select("column", profile.role_of(F.col("column")).alias("role")), "SELECT \"column\", " + _ROLE + " AS role FROM (VALUES " + ", ".join(f"('{c}')" for c in TEXT) + ") x(\"column\")")

# value checks
_HALF_EMPTY = DIRTY_ORDERS.replace("% 17 = 0", "% 3 = 0")
_add("completeness", _rows(lambda r, n: V.row_completeness(r, TEXT, n), sql=_HALF_EMPTY), _d(TEXT, _HALF_EMPTY) + _obs("completeness", "CASE WHEN o * 100.0 / total >= 20 THEN 'error' ELSE 'warning' END", "completeness_validator", "SELECT c, sum(n) AS o FROM d, t WHERE missing GROUP BY c, total HAVING sum(n) * 100.0 / total >= 5"))
_add("type_mismatch", _check(["price"], lambda v, n: V.type_mismatch(v, {"price": "integer"}, n)), _d(["price"]) + _obs("type_mismatch", "CASE WHEN o * 100.0 / total > 10 THEN 'error' ELSE 'warning' END", "type_validator", "SELECT c, sum(n) AS o FROM d WHERE NOT missing AND NOT regexp_matches(trim(v), '^[+-]?[0-9]+$') GROUP BY c"))
_add("range_violation", _check(["price"], lambda v, n: V.out_of_range(v, {"price": (1000, 200000)}, n)), _d(["price"]) + _obs("outlier", "'info'", "range_validator", f"SELECT c, sum(n) AS o FROM d WHERE NOT missing AND ({_NUM} < 1000 OR {_NUM} > 200000) GROUP BY c"))
_add("set_violation", _check(["status"], lambda v, n: V.not_in_set(v, {"status": ["O", "F", "P"]}, n)), _d(["status"]) + _obs("constraint_violation", "'warning'", "set_validator", "SELECT c, sum(n) AS o FROM d WHERE NOT missing AND trim(v) NOT IN ('O','F','P') GROUP BY c"))
_add("unique_violation", _check(["customer_code", "url"], lambda v, n: V.not_unique(v, ["customer_code", "url"], n)), _d(["customer_code", "url"]) + _obs("duplicate", "'error'", "uniqueness_validator", "SELECT c, sum(n - 1) AS o FROM d WHERE NOT missing AND n > 1 GROUP BY c"))
_add("identifier_duplicates", _check(["status"], lambda v, n: V.duplicate_identifiers(v, ["status"], n)), _d(["status"]) + _obs("duplicate", "'error'", "identifier_duplicate_validator", "SELECT c, sum(n - 1) AS o FROM (SELECT c, trim(v) AS w, sum(n) AS n FROM d WHERE NOT missing GROUP BY 1, 2) WHERE n > 1 GROUP BY c"))
for _c, _t in (("o_totalprice", "orders"), ("value", "events"), ("c_acctbal", "customer")):
    _add(f"iqr_outliers_{_t}", lambda s, d, c=_c, t=_t: V.iqr_outliers(_table(s, d, t), c), f"WITH r AS (SELECT {_c} AS v, row_number() OVER (ORDER BY {_c}) - 1 AS k, count(*) OVER () AS n FROM {_t} WHERE {_c} IS NOT NULL), q AS (SELECT max(CASE WHEN k = floor(0.25 * (n - 1) + 0.5) THEN v END) AS q1, max(CASE WHEN k = floor(0.5 * (n - 1) + 0.5) THEN v END) AS median, max(CASE WHEN k = floor(0.75 * (n - 1) + 0.5) THEN v END) AS q3 FROM r) SELECT '{_c}' AS \"column\", q1, median, q3, count(*) AS n, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS occurrences FROM r, q GROUP BY q1, median, q3")
_add("negative_values", _check(["price"], V.negative_values), _d(["price"]) + _obs("outlier", "'error'", "statistical_outlier_validator", f"SELECT c, sum(n) AS o FROM d WHERE NOT missing AND {_NUM} < 0 GROUP BY c", "0.95"))
_add("case_inconsistency", _check(["status"], lambda v, n: V.inconsistent_case(v, {"status": ["O", "F", "P"]}, n)), _d(["status"]) + _obs("inconsistency", "'warning'", "consistency_validator", "SELECT c, count(DISTINCT trim(v)) AS o FROM d WHERE NOT missing AND trim(v) NOT IN ('O','F','P') AND lower(trim(v)) IN ('o','f','p') GROUP BY c"))
_add("case_variants", _check(["status", "priority"], lambda v, n: V.case_variants(v, ["status", "priority"], n)), _d(["status", "priority"]) + _obs("inconsistency", "'warning'", "case_variant_validator", "SELECT c, sum(n) AS o FROM (SELECT c, lower(trim(v)) AS g, count(DISTINCT trim(v)) AS k, sum(n) AS n FROM d WHERE NOT missing GROUP BY 1, 2) WHERE k > 1 GROUP BY c"))
_CLOSE = "SELECT a.c, a.v AS typo, arg_max(b.v, (b.n, -b.first_row)) AS suggestion, max(b.n) AS n FROM d a JOIN d b ON a.c = b.c AND a.n = 1 AND b.n > 1 AND strlen(a.v) >= 4 AND strlen(b.v) >= 4 AND NOT a.missing AND NOT b.missing AND levenshtein(a.v, b.v) BETWEEN 1 AND 2 AND levenshtein(a.v, b.v) < strlen(a.v) // 2 GROUP BY 1, 2"
_add("typo_pairs", lambda s, d: V.typo_pairs(value_dictionary(_dirty(s, d), ["priority", "price"]), ["priority", "price"]), _d(["priority", "price"]) + f'SELECT c AS "column", typo, suggestion, n FROM ({_CLOSE})')
_add("typos", _check(["priority"], lambda v, n: V.typos(v, ["priority"], n)), _d(["priority"]) + _obs("inconsistency", "'warning'", "typo_validator", f"SELECT c, count(*) AS o FROM ({_CLOSE}) GROUP BY c"))
_SYN: dict[str, str] = {}
for _group in V.SYNONYMS:
    for _term in _group:
        _SYN.setdefault(_term.lower(), _group[0])
_SYN_ROWS = ", ".join("('{}', '{}')".format(k.replace("'", "''"), c.replace("'", "''")) for k, c in _SYN.items())
_add("synonyms", _check(["answer"], lambda v, n: V.synonyms(v, ["answer"], n)), _d(["answer"]) + f", y(term, canonical) AS (VALUES {_SYN_ROWS}) " + _obs("inconsistency", "'warning'", "semantic_equivalence_validator", "SELECT c, sum(n) AS o FROM (SELECT c, canonical, count(DISTINCT v) AS k, sum(n) AS n FROM d JOIN y ON lower(trim(v)) = term WHERE NOT missing GROUP BY 1, 2) WHERE k > 1 GROUP BY c"))
_WAY = "CASE WHEN regexp_matches(trim(v), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'iso' WHEN regexp_matches(trim(v), '^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$') THEN 'ymd_slash' WHEN regexp_matches(trim(v), '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN 'mdy_slash' WHEN regexp_matches(trim(v), '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$') THEN 'mdy_dash' WHEN regexp_matches(v, '(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)') THEN 'month_name' END"
_add("date_formats", lambda s, d: V.date_formats(value_dictionary(_dirty(s, d), ["order_date"]), ["order_date"]), _d(["order_date"]) + f'SELECT c AS "column", {_WAY} AS format, CAST(sum(n) AS BIGINT) AS n FROM d WHERE NOT missing GROUP BY 1, 2')
_add("date_standardize", lambda s, d: _dirty(s, d).select(F.col("_row_id").alias("order_id"), T.iso_date(F.col("order_date")).alias("iso")), "SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
_add("missing_patterns", _check(["status", "price"], V.missing_patterns), _d(["status", "price"]) + _obs("missing_pattern", "'warning'", "missing_pattern_validator", "SELECT c || '=' || lower(trim(v)) AS c, sum(n) AS o FROM d WHERE lower(trim(v)) IN (" + "'missing','unknown','not available','not recorded','n.a.','n.a','na.','#n/a','#null','undefined','-999','-9999','999','9999'" + ") GROUP BY 1 HAVING sum(n) >= 2"))
_add("url_pattern", _check(["url"], lambda v, n: V.name_patterns(v, ["url"], n)), _d(["url"]) + _obs("pattern_violation", "CASE WHEN o * 100.0 / there > 10 THEN 'warning' ELSE 'info' END", "regex_pattern_validator", r"SELECT c, sum(CASE WHEN regexp_matches(trim(v), '^https?://[^\s]+$') THEN 0 ELSE n END) AS o, sum(n) AS there FROM d WHERE NOT missing GROUP BY c HAVING o > 0 AND o * 2 <= there"))
_SHAPE = "regexp_replace(regexp_replace(regexp_replace(trim(v), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '#', 'g')"
_add("id_shape", _check(["customer_code"], lambda v, n: V.id_shapes(v, ["customer_code"], n)), _d(["customer_code"]) + _obs("inconsistency", "'warning'", "regex_pattern_validator", f"SELECT c, sum(n) - max(n) AS o FROM (SELECT c, {_SHAPE} AS s, sum(n) AS n FROM d WHERE NOT missing GROUP BY 1, 2) GROUP BY c HAVING count(*) > 1 AND max(n) >= 0.7 * sum(n)", "0.80"))
_add("mixed_dates", _check(["order_date"], lambda v, n: V.mixed_dates(v, ["order_date"], n)), _d(["order_date"]) + "SELECT type, severity, \"column\", detector, confidence, occurrences, CAST(100 AS DOUBLE) AS percentage FROM (" + _obs("inconsistency", "'warning'", "date_format_validator", f"SELECT c, sum(n) AS o FROM (SELECT c, {_WAY} AS way, sum(n) AS n FROM d WHERE NOT missing GROUP BY 1, 2) WHERE way IS NOT NULL GROUP BY c HAVING count(*) > 1") + ")")
_add("title_case", _check(["treatment"], lambda v, n: V.small_titles(v, ["treatment"], n)), _d(["treatment"]) + _obs("inconsistency", "'info'", "title_case_validator", "SELECT c, sum(n) AS o FROM d WHERE NOT missing AND regexp_matches(v, '^[a-z]') GROUP BY c"))
_add("latitude_range", _check(["latitude"], lambda v, n: V.bad_coordinates(v, "latitude", 90, n)), _d(["latitude"]) + _obs("outlier", "'error'", "coordinate_validator", "SELECT c, sum(n) AS o FROM d WHERE NOT missing AND abs(CAST(regexp_replace(trim(v), '\\s*[NSEW]$', '') AS DOUBLE)) > 90 GROUP BY c"))

_PLACES = DIRTY_ORDERS.replace("'95.5'", "'181.5'").replace("'91 S'", "'190 W'").replace(" AS latitude", " AS longitude")
_add("longitude_range", _check(["longitude"], lambda v, n: V.bad_coordinates(v, "longitude", 180, n), sql=_PLACES), _d(["longitude"], _PLACES) + _obs("outlier", "'error'", "coordinate_validator", "SELECT c, sum(n) AS o FROM d WHERE v IN ('181.5', '190 W') GROUP BY c"))

# row checks
_PEOPLE = {"sql": DIRTY_PEOPLE, "source": "customer", "key": "person_id"}


_P = f"WITH dirty AS ({DIRTY_PEOPLE}), t AS (SELECT count(*) AS total FROM dirty) "
_PLAIN = "CASE WHEN regexp_matches({0}, '^[0-9]+/[0-9]+/[0-9]{{4}}$') THEN split_part({0}, '/', 3) || '-' || lpad(split_part({0}, '/', 1), 2, '0') || '-' || lpad(split_part({0}, '/', 2), 2, '0') ELSE {0} END"
_add("date_order", _rows(lambda r, n: V.late_start(r, "start_date", "end_date", n), **_PEOPLE), _P + _obs("cross_column_inconsistency", "'warning'", "cross_column_validator", f"SELECT 'start_date vs end_date' AS c, count(*) AS o FROM dirty WHERE {_PLAIN.format('start_date')} > {_PLAIN.format('end_date')} HAVING count(*) > 0"))
_add("bmi", _rows(lambda r, n: V.wrong_bmi(r, "bmi", "weight", "height", n), **_PEOPLE), _P + _obs("cross_column_inconsistency", "'warning'", "cross_column_validator", "SELECT 'bmi' AS c, count(*) AS o FROM (SELECT CAST(bmi AS DOUBLE) AS b, CAST(weight AS DOUBLE) / power(CASE WHEN CAST(height AS DOUBLE) > 3 THEN CAST(height AS DOUBLE) / 100 ELSE CAST(height AS DOUBLE) END, 2) AS own FROM dirty) WHERE abs(b - own) / own > 0.1 HAVING count(*) > 0", "0.70"))
_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
_LINES = f"SELECT l_orderkey * 10 + l_linenumber AS line_id, {', '.join(f'{c} % 40 AS {c}' if c.endswith('key') else c for c in _LINE)} FROM lineitem"
_LW = {"sql": _LINES, "source": "lineitem", "key": "line_id"}
_L = f"WITH dirty AS ({_LINES}), t AS (SELECT count(*) AS total FROM dirty) "
_add("dup_exact", _rows(lambda r, n: V.duplicate_rows(r, _LINE, n), **_LW), _L + _obs("duplicate", "'error'", "duplicate_row_validator", f"SELECT '_table' AS c, sum(n - 1) AS o FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(_LINE)}) WHERE n > 1 HAVING sum(n - 1) > 0"))
_add("dup_near", _rows(lambda r, n: V.near_duplicate_rows(r, "l_partkey", _LINE[1:], n), **_LW), _L + _obs("duplicate", "'warning'", "duplicate_row_validator", "SELECT '_table' AS c, count(*) AS o FROM (SELECT 1 FROM dirty GROUP BY l_suppkey, l_quantity, l_returnflag HAVING count(DISTINCT l_partkey) > 1) HAVING count(*) > 0", "0.85"))
_add("id_conflict", _rows(lambda r, n: V.conflicting_identifiers(r, "l_partkey", _LINE[1:], n), **_LW), _L + _obs("duplicate", "'error'", "duplicate_row_validator", "SELECT 'l_partkey' AS c, count(*) AS o FROM (SELECT l_partkey FROM dirty GROUP BY l_partkey HAVING count(DISTINCT (l_suppkey, l_quantity, l_returnflag)) > 1) HAVING count(*) > 0", "0.95"))

# life-science vocabularies
_ACC = "CASE " + " ".join(f"WHEN regexp_matches(upper(trim(v)), '{p.replace(chr(92) + 'z', '$')}') THEN '{n}'" for n, p in accession.PATTERNS) + " ELSE 'invalid' END"
_DP = _d(["accession", "organism"], DIRTY_PEOPLE, "person_id")
_add("accession_class", lambda s, d: accession.accession_counts(value_dictionary(_dirty(s, d, **_PEOPLE), ["accession"]), "accession"), _DP + f"SELECT {_ACC} AS accession_type, CAST(sum(n) AS BIGINT) AS n FROM d WHERE c = 'accession' GROUP BY 1")
_NAMES = ", ".join(f"('{n}')" for _, n in taxonomy.NAMES)
_SHORT = ", ".join(f"('{k}', '{f}')" for a, f in taxonomy.ABBREVIATIONS for k in (a.lower(), a.replace(".", "").lower()))
_add("taxonomy_match", lambda s, d: taxonomy.match(value_dictionary(_dirty(s, d, **_PEOPLE), ["organism"]), "organism"), _DP + f", names(name) AS (VALUES {_NAMES}), short(k, f) AS (VALUES {_SHORT}), o AS (SELECT trim(v) AS value, CAST(sum(n) AS BIGINT) AS n FROM d WHERE c = 'organism' GROUP BY 1), near AS (SELECT value, arg_min(name, (levenshtein(lower(value), lower(name)), name)) AS near FROM o, names WHERE levenshtein(lower(value), lower(name)) BETWEEN 1 AND 2 GROUP BY 1) SELECT o.value, o.n, CASE WHEN f IS NOT NULL THEN 'abbreviation' WHEN name = o.value THEN 'valid' WHEN name IS NOT NULL THEN 'case_error' WHEN near IS NOT NULL THEN 'possible_typo' ELSE 'unknown' END AS status, coalesce(f, name, near) AS name FROM o LEFT JOIN short ON lower(o.value) = k LEFT JOIN names ON lower(o.value) = lower(name) LEFT JOIN near ON near.value = o.value")

# curation
_OBS = ["completeness", "type_mismatch", "set_violation", "negative_values", "case_variants", "missing_patterns", "synonyms"]


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = QUERIES[_OBS[0]](spark, sf_dir)
    for name in _OBS[1:]:
        out = out.unionByName(QUERIES[name](spark, sf_dir))
    return out


_UNION = " UNION ALL ".join(f"(SELECT * FROM ({ORACLE_SQL[n]}))" for n in _OBS)
_NUMBERED = f"SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, detector, \"column\", type, occurrences) AS observation_id FROM ({_UNION})"
_SUGGEST = f"SELECT observation_id, \"column\", CASE WHEN type = 'inconsistency' THEN 'standardize' WHEN type = 'type_mismatch' THEN CASE WHEN percentage < 10 THEN 'coerce' ELSE 'flag' END WHEN type IN ('outlier', 'constraint_violation') THEN 'flag' WHEN type = 'completeness' AND percentage >= 20 THEN 'flag' WHEN type = 'missing_pattern' THEN 'convert_na' END AS action, CAST(CASE WHEN type = 'inconsistency' THEN 2 WHEN type = 'type_mismatch' THEN CASE WHEN percentage < 10 THEN 3 ELSE 2 END WHEN type = 'outlier' THEN CASE WHEN severity = 'error' THEN 2 ELSE 4 END WHEN type = 'completeness' THEN 4 WHEN type = 'missing_pattern' THEN 3 ELSE 2 END AS INTEGER) AS priority FROM ({_NUMBERED})"
_add("severity_rollup", lambda s, d: curation.severity_counts(_observations(s, d)), f"SELECT severity, count(*) AS n, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM ({_UNION}) GROUP BY severity")
_add("quality_score", lambda s, d: curation.quality_score(_observations(s, d), 40), f"SELECT round(greatest(0, least(1, 1 - count(DISTINCT \"column\") / CAST(40 AS DOUBLE) - least(0.5, CAST(0.1 AS DOUBLE) * count(*) FILTER (severity = 'error') + CAST(0.02 AS DOUBLE) * count(*) FILTER (severity = 'warning') + CAST(0.005 AS DOUBLE) * count(*) FILTER (severity = 'info')))), 6) AS score FROM ({_UNION})")
_add("suggestions", lambda s, d: curation.suggestions(curation.number_observations(_observations(s, d))).select("observation_id", "column", "action", "priority"), f"SELECT * FROM ({_SUGGEST}) WHERE action IS NOT NULL")


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    suggested = curation.suggestions(curation.number_observations(_observations(spark, sf_dir)))
    return curation.pending(suggested, suggested.filter("observation_id % 2 = 0")).select("observation_id", "action")


_add("pending_antijoin", _pending, f"SELECT observation_id, action FROM ({_SUGGEST}) WHERE action IS NOT NULL AND observation_id % 2 <> 0")
_OPERATIONS = [("convert_na", "status", {"tokens": ["missing"]}), ("standardize", "status", {"mapping": {"o": "O", "f": "F", "p": "P", " O": "O", " F": "F", " P": "P"}}), ("coerce", "price", {"kind": "integer"}), ("convert_date", "order_date", {})]
_STATUS = "CASE WHEN status = 'missing' THEN '' WHEN status IN ('o', 'f', 'p') THEN upper(status) WHEN status IN (' O', ' F', ' P') THEN trim(status) ELSE status END"
_PRICE = "CASE WHEN regexp_matches(price, '^-?[0-9]+$') THEN price ELSE '' END"
_ISO = "strftime(o_orderdate, '%Y-%m-%d')"
_add("apply_decisions", lambda s, d: curation.apply_operations(_dirty(s, d), _OPERATIONS)[0].select(F.col("_row_id").alias("order_id"), "status", "price", "order_date"), f"WITH dirty AS ({DIRTY_ORDERS}) SELECT order_id, {_STATUS} AS status, {_PRICE} AS price, {_ISO} AS order_date FROM dirty JOIN orders ON o_orderkey = order_id")
_add("row_audit", lambda s, d: curation.apply_operations(_dirty(s, d), _OPERATIONS)[1].groupBy("column", "reason").agg(F.count("*").alias("n")), f"WITH dirty AS ({DIRTY_ORDERS}) SELECT 'status' AS \"column\", 'convert_na' AS reason, count(*) AS n FROM dirty WHERE status = 'missing' UNION ALL SELECT 'status', 'standardize', count(*) FROM dirty WHERE status IN ('o','f','p',' O',' F',' P') UNION ALL SELECT 'price', 'coerce', count(*) FROM dirty WHERE price <> {_PRICE} UNION ALL SELECT 'order_date', 'convert_date', count(*) FROM dirty JOIN orders ON o_orderkey = order_id WHERE order_date <> {_ISO}")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, audit = curation.apply_operations(_dirty(spark, sf_dir).select("_row_id", "status", "price"), _OPERATIONS[2:3])
    return curation.with_audit_columns(out, audit).select(F.col("_row_id").alias("order_id"), "price", "_modified", "_original", "_reason")


_add("audit_columns", _audited, f"WITH dirty AS ({DIRTY_ORDERS}), x AS (SELECT order_id, price AS old, {_PRICE} AS price FROM dirty) SELECT order_id, price, CASE WHEN old <> price THEN 'price=' || price END AS _modified, CASE WHEN old <> price THEN 'price=' || old END AS _original, CASE WHEN old <> price THEN 'price=coerce' END AS _reason FROM x")
_add("coerced", lambda s, d: _dirty(s, d).select(F.col("_row_id").alias("order_id"), *[curation.coerce(F.col(c), k).alias(f"{c}_{k}") for c, k in (("price", "integer"), ("price", "float"), ("answer", "boolean"), ("status", "string"))]), f"WITH dirty AS ({DIRTY_ORDERS}) SELECT order_id, {_PRICE} AS price_integer, CASE WHEN price IN ('n/a', 'abc') THEN '' ELSE price END AS price_float, CASE WHEN answer IN ('yes', 'Y') THEN 'true' WHEN answer IN ('no', 'N') THEN 'false' ELSE '' END AS answer_boolean, status AS status_string FROM dirty")
_add("page_slice", lambda s, d: _table(s, d, "orders").orderBy("o_orderkey").offset(200).limit(100).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
_add("windowed_rates", lambda s, d: windowed_rates(_table(s, d, "events"), 1.0, 50.0), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, count(*) FILTER (value IS NULL) AS n_missing, count(*) FILTER (value < 1 OR value > 50) AS n_outside FROM events GROUP BY 1, 2")


_QUARTILES = ""


def _report_sql() -> str:
    """Every check that the dirty orders call for, by hand: which columns are numbers, texts, sets and dates is known."""
    words, few = "c IN ('status', 'priority', 'answer', 'url', 'treatment', 'customer_code')", "c IN ('status', 'priority', 'answer', 'treatment')"
    error, warning, info = "'error'", "'warning'", "'info'"
    pattern = r"^https?://[^\s]+$"
    content = ", ".join(f"lower(trim({c}))" for c in TEXT)
    far = f"SELECT d.c, sum(d.n) AS o FROM d JOIN q ON q.c = d.c WHERE NOT missing AND ({_NUM} < q1 - 1.5 * (q3 - q1) OR {_NUM} > q3 + 1.5 * (q3 - q1)) GROUP BY d.c"
    pieces = [
        _obs("outlier", error, "coordinate_validator", "SELECT c, sum(n) AS o FROM d WHERE c = 'latitude' AND abs(CAST(regexp_replace(trim(v), '\\s*[NSEW]$', '') AS DOUBLE)) > 90 GROUP BY c"),
        _obs("outlier", error, "statistical_outlier_validator", f"SELECT c, sum(n) AS o FROM d WHERE c = 'price' AND NOT missing AND {_NUM} < 0 GROUP BY c", "0.95"),
        _obs("outlier", "CASE WHEN o > 1 THEN 'warning' ELSE 'info' END", "statistical_outlier_validator", far),
        _obs("outlier", info, "range_validator", f"SELECT d.c, sum(d.n) AS o FROM d JOIN q ON q.c = d.c WHERE NOT missing AND ({_NUM} < low OR {_NUM} > high) GROUP BY d.c"),
        _obs("type_mismatch", "CASE WHEN o * 100.0 / total > 10 THEN 'error' ELSE 'warning' END", "type_validator", f"SELECT c, sum(n) AS o FROM d WHERE c IN ('price', 'latitude') AND NOT missing AND NOT regexp_matches(trim(v), '{_NUMBER}') GROUP BY c"),
        _obs("completeness", "CASE WHEN o * 100.0 / total >= 20 THEN 'error' ELSE 'warning' END", "completeness_validator", "SELECT c, sum(n) AS o FROM d, t WHERE missing GROUP BY c, total HAVING sum(n) * 100.0 / total >= 5"),
        _obs("missing_pattern", warning, "missing_pattern_validator", "SELECT c || '=' || lower(trim(v)) AS c, sum(n) AS o FROM d WHERE lower(trim(v)) IN ('missing','unknown','not available','not recorded','n.a.','n.a','na.','#n/a','#null','undefined','-999','-9999','999','9999') GROUP BY 1 HAVING sum(n) >= 2"),
        _obs("inconsistency", warning, "case_variant_validator", f"SELECT c, sum(n) AS o FROM (SELECT c, lower(trim(v)) AS g, count(DISTINCT trim(v)) AS k, sum(n) AS n FROM d WHERE NOT missing AND {words} GROUP BY 1, 2) WHERE k > 1 GROUP BY c"),
        _obs("inconsistency", warning, "semantic_equivalence_validator", f"SELECT c, sum(n) AS o FROM (SELECT c, canonical, count(DISTINCT v) AS k, sum(n) AS n FROM d JOIN y ON lower(trim(v)) = term WHERE NOT missing AND {words} GROUP BY 1, 2) WHERE k > 1 GROUP BY c"),
        _obs("inconsistency", warning, "typo_validator", f"SELECT c, count(*) AS o FROM ({_CLOSE}) WHERE {words} GROUP BY c"),
        _obs("inconsistency", info, "title_case_validator", "SELECT c, sum(n) AS o FROM d WHERE c = 'treatment' AND NOT missing AND regexp_matches(v, '^[a-z]') GROUP BY c"),
        _obs("inconsistency", warning, "consistency_validator", f"SELECT c, count(DISTINCT trim(v)) AS o FROM d WHERE NOT missing AND {few} AND NOT EXISTS (SELECT 1 FROM d e WHERE e.c = d.c AND NOT e.missing AND e.v = trim(d.v)) AND EXISTS (SELECT 1 FROM d e WHERE e.c = d.c AND NOT e.missing AND lower(e.v) = lower(trim(d.v))) GROUP BY c"),
        _obs("constraint_violation", warning, "set_validator", f"SELECT c, sum(n) AS o FROM d WHERE NOT missing AND {few} AND NOT EXISTS (SELECT 1 FROM d e WHERE e.c = d.c AND NOT e.missing AND e.v = trim(d.v)) GROUP BY c"),
        _obs("pattern_violation", "CASE WHEN o * 100.0 / there > 10 THEN 'warning' ELSE 'info' END", "regex_pattern_validator", f"SELECT c, sum(CASE WHEN regexp_matches(trim(v), '{pattern}') THEN 0 ELSE n END) AS o, sum(n) AS there FROM d WHERE c = 'url' AND NOT missing GROUP BY c HAVING o > 0 AND o * 2 <= there"),
        _obs("duplicate", error, "duplicate_row_validator", f"SELECT '_table' AS c, sum(n - 1) AS o FROM (SELECT count(*) AS n FROM dirty GROUP BY {content}) HAVING sum(n - 1) > 0"),
        _obs("duplicate", warning, "duplicate_row_validator", f"SELECT '_table' AS c, count(*) AS o FROM (SELECT 1 FROM dirty GROUP BY {content} HAVING count(DISTINCT order_id) > 1) HAVING count(*) > 0", "0.85"),
        _obs("inconsistency", warning, "date_format_validator", f"SELECT c, sum(n) AS o FROM (SELECT c, {_WAY} AS way, sum(n) AS n FROM d WHERE c = 'order_date' AND NOT missing GROUP BY 1, 2) WHERE way IS NOT NULL GROUP BY c HAVING count(*) > 1").replace("round(o * CAST(100 AS DOUBLE) / total, 4)", "CAST(100 AS DOUBLE)"),
    ]
    ranked = "r AS (SELECT c, x, n, sum(n) OVER (PARTITION BY c ORDER BY x) AS upto, sum(n) OVER (PARTITION BY c) AS all_n FROM (SELECT c, CAST(v AS DOUBLE) AS x, sum(n) AS n FROM d WHERE c IN ('price', 'latitude') AND NOT missing AND regexp_matches(v, '" + _NUMBER + "') GROUP BY 1, 2))"
    at = lambda p: f"min(CASE WHEN upto > floor({p} * (all_n - 1) + 0.5) THEN x END)"
    quartiles = f"q AS MATERIALIZED (SELECT c, {at(0.25)} AS q1, {at(0.75)} AS q3, min(x) AS low, max(x) AS high FROM r GROUP BY c)"
    union = " UNION ALL ".join(f"(SELECT type, severity, \"column\", detector, occurrences, percentage FROM ({p}))" for p in pieces)
    order = "CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, detector, \"column\", type, occurrences"
    global _QUARTILES
    _QUARTILES = f"{ranked}, {quartiles}"
    return _d(TEXT) + f", {ranked}, {quartiles}, y(term, canonical) AS (VALUES {_SYN_ROWS}) SELECT row_number() OVER (ORDER BY {order}) AS observation_id, * FROM ({union})"


_add("quality_report", lambda s, d: quality_report(s.sql(DIRTY_ORDERS.replace("FROM orders", "FROM {o}"), o=_table(s, d, "orders")), "order_id"), _report_sql())


def _analyzed(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyze(spark.sql(DIRTY_ORDERS.replace("FROM orders", "FROM {o}"), o=_table(spark, sf_dir, "orders")), "order_id")


def _about(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each observation is about, and which."""
    found = _analyzed(spark, sf_dir)
    rows = evidence.about(found, found.observations).join(F.broadcast(found.observations), "observation_id")  # a row for each finding
    return rows.groupBy("detector", "column", "confidence").agg(F.count("*").alias("n"), F.min("_row_id").alias("first_row"), F.sum("_row_id").alias("row_sum"))


_WORDS = ["status", "priority", "answer", "url", "treatment", "customer_code"]
_OUT = lambda c: f"({_NUM.replace('trim(v)', f'trim({c})')} < (SELECT q1 - 1.5 * (q3 - q1) FROM q WHERE c = '{c}') OR {_NUM.replace('trim(v)', f'trim({c})')} > (SELECT q3 + 1.5 * (q3 - q1) FROM q WHERE c = '{c}'))"
_BAD_LATITUDE = "abs(CAST(regexp_replace(trim(latitude), '\\s*[NSEW]$', '') AS DOUBLE)) > 90"
_SPELT = "l.v <> '' AND lower(trim(l.v)) NOT IN ('na','n/a','null','none','nil','.','-')"
_ABOUT = [
    ("coordinate_validator", "latitude", "0.95", f"SELECT order_id FROM dirty WHERE {_BAD_LATITUDE}"),
    ("statistical_outlier_validator", "price", "0.95", "SELECT order_id FROM dirty WHERE price = '-5'"),
    *[("statistical_outlier_validator", c, "0.85", f"SELECT order_id FROM dirty WHERE {_OUT(c)}") for c in ("price", "latitude")],
    ("type_validator", "price", "0.9", "SELECT order_id FROM dirty WHERE price = 'abc'"),
    ("type_validator", "latitude", "0.9", "SELECT order_id FROM dirty WHERE latitude = '91 S'"),
    ("missing_pattern_validator", "status=missing", "0.88", "SELECT order_id FROM dirty WHERE status = 'missing'"),
    *[("case_variant_validator", c, "0.9", f"SELECT order_id FROM dirty WHERE trim({c}) <> '' AND lower(trim({c})) IN (SELECT lower(trim({c})) FROM dirty GROUP BY 1 HAVING count(DISTINCT trim({c})) > 1)") for c in _WORDS],
    *[("semantic_equivalence_validator", c, "0.85", f"SELECT order_id FROM (SELECT order_id, min({c}) OVER (PARTITION BY canonical) <> max({c}) OVER (PARTITION BY canonical) AS mixed FROM dirty JOIN y ON lower(trim({c})) = term) WHERE mixed") for c in _WORDS],
    ("title_case_validator", "treatment", "0.85", "SELECT order_id FROM dirty WHERE treatment = 'aspirin'"),
    ("regex_pattern_validator", "url", "0.75", "SELECT order_id FROM dirty WHERE url = 'not a link'"),
    ("date_format_validator", "order_date", "0.9", "SELECT order_id FROM dirty"),
]
_ABOUT_WITH = _d(TEXT) + f", {_QUARTILES}, y(term, canonical) AS (VALUES {_SYN_ROWS}) "
_add("observed_rows", _about, _ABOUT_WITH + " UNION ALL ".join(f"SELECT '{v}' AS detector, '{c}' AS \"column\", CAST({sure} AS DOUBLE) AS confidence, count(*) AS n, min(order_id) AS first_row, CAST(sum(order_id) AS BIGINT) AS row_sum FROM ({sql}) HAVING count(*) > 0" for v, c, sure, sql in _ABOUT))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty orders with the flags that all suggestions to flag set."""
    found = _analyzed(spark, sf_dir)
    suggested = curation.suggestions(found.observations).filter("action = 'flag'")
    plan = apply.resolved(decisions.decide(suggested, None, decisions.ACCEPTED), suggested, found.observations)
    rows, marks = evidence.marked(found, found.observations.join(suggested.select("observation_id"), "observation_id", "left_semi"))
    done = apply.apply_decided(rows, plan, apply.mappings(found.values), {}, marks).rows
    return done.select(F.col("_row_id").alias("order_id"), "price_flagged", "latitude_flagged", "url_invalid_format")


_add("flagged_table", _flagged, _ABOUT_WITH + f"SELECT order_id, CASE WHEN coalesce({_OUT('price')}, false) THEN 'outlier' WHEN price = '-5' THEN 'invalid_value' ELSE '' END AS price_flagged, CASE WHEN coalesce({_OUT('latitude')}, false) THEN 'outlier' WHEN {_BAD_LATITUDE} THEN 'invalid_value' ELSE '' END AS latitude_flagged, CASE WHEN url = 'not a link' THEN 'pattern_violation' ELSE '' END AS url_invalid_format FROM dirty")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of each observation, and the first spellings of the first group where spellings are compared."""
    found = evidence.evidence(_analyzed(spark, sf_dir)).filter("check in ('case_variant', 'title_case', 'name_pattern', 'missing_pattern')")
    return found.select("detector", "column", F.array_join("sample_rows", ",").alias("sample_rows"), F.to_json("value_counts").alias("value_counts"))


def _first_rows(sql: str) -> str:
    return f"(SELECT string_agg(order_id::VARCHAR, ',' ORDER BY order_id) FROM (SELECT order_id FROM ({sql}) ORDER BY order_id LIMIT 5))"


_KEYED = {"case_variant_validator": "lower(trim({0}))", "title_case_validator": "''", "regex_pattern_validator": "''", "missing_pattern_validator": "''"}
_PROOF = []
for _v, _c, _, _sql in _ABOUT:
    if _v in _KEYED:
        _own = _c.partition("=")[0]
        _k = _KEYED[_v].format(_own)
        _PROOF.append(f"SELECT '{_v}' AS detector, '{_c}' AS \"column\", {_first_rows(_sql)} AS sample_rows, (SELECT '{{' || string_agg('\"' || k || '\":{{' || counts || '}}', ',' ORDER BY k) || '}}' FROM (SELECT k, string_agg('\"' || s || '\":' || n, ',' ORDER BY s) AS counts FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY f, s) AS j FROM (SELECT {_k} AS k, trim({_own}) AS s, count(*) AS n, min(order_id) AS f FROM dirty WHERE order_id IN ({_sql}) GROUP BY 1, 2)) WHERE j <= 5 AND k IN (SELECT k FROM (SELECT {_k} AS k, min(order_id) AS f FROM dirty WHERE order_id IN ({_sql}) GROUP BY 1) ORDER BY f, k LIMIT 5) GROUP BY k)) AS value_counts")
_add("evidence", _evidence, _ABOUT_WITH + "SELECT * FROM (" + " UNION ALL ".join(_PROOF) + ") WHERE sample_rows IS NOT NULL")

def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of standardizations without parameters: of status by evidence, of priority by data, of typos by their text."""
    found = _analyzed(spark, sf_dir)
    seen = evidence.evidence(found, found.observations.filter("check = 'case_variant' and column in ('status', 'priority')"))
    told = seen.select("observation_id", "type", "column", F.lit("Case variants of values").alias("description"), F.when(F.col("column") == "status", F.col("value_counts")).alias("value_counts"))
    pairs = V.typo_pairs(found.values, ["priority"]).groupBy("column").agg(F.concat(F.lit("Possible typos: "), F.array_join(F.collect_list(F.concat(F.lit("'"), "typo", F.lit("' → '"), "suggestion", F.lit("'"))), ", ")).alias("description"))
    typos = pairs.select(F.lit(-1).cast("long").alias("observation_id"), F.lit("inconsistency").alias("type"), "column", "description", F.lit(None).cast("variant").alias("value_counts"))
    asked = staged(told.unionByName(typos), "asked")
    return fallback.fallback_mapping(asked, found.values).join(asked.select("observation_id", "column"), "observation_id").select("column", "value", "new", "source")


_SPELLINGS = "SELECT c, lower(trim(v)) AS g, trim(v) AS v, sum(n) AS n, min(first_row) AS f FROM d WHERE NOT missing AND c = '{0}' GROUP BY 1, 2, 3"
_VARIED = "(SELECT *, count(*) OVER (PARTITION BY g) AS k FROM ({0}))"
_add("fallback_mapping", _fallback, _d(TEXT) + f"SELECT c AS \"column\", v AS value, new, 'evidence' AS source FROM (SELECT *, first_value(v) OVER (PARTITION BY g ORDER BY n DESC, v) AS new FROM {_VARIED.format(_SPELLINGS.format('status'))} WHERE k > 1) WHERE v <> new UNION ALL SELECT c, v, new, 'data' FROM (SELECT *, first_value(v) OVER (PARTITION BY g ORDER BY n DESC, f DESC) AS new FROM {_VARIED.format(_SPELLINGS.format('priority'))} WHERE k > 1) WHERE v <> new UNION ALL SELECT c, typo, suggestion, 'text' FROM ({_CLOSE}) WHERE c = 'priority'")


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files with quoted cells, line feeds and quotes in them, and read again by blocks."""
    path = new_folder(spark, "quoted")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("doc_id", "lang", "source", "text")]
    _table(spark, sf_dir, "documents").select(*cells).write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    return quoted.read_quoted(spark, path, ",").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")


_add("quoted_rows", _quoted, "SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents")


# sample tables
DIRTY_SAMPLES = """
SELECT c_custkey AS sample_id, CASE c_custkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' WHEN 2 THEN 'M' ELSE 'F' END AS sex,
  CASE WHEN c_custkey % 6 = 0 THEN 'Yes' ELSE 'no' END AS pregnant, CAST(c_custkey % 70 AS STRING) AS age,
  CASE c_custkey % 5 WHEN 0 THEN 'Type 2 Diabetes' WHEN 1 THEN 'asthma' ELSE 'none' END AS diagnosis,
  CASE c_custkey % 7 WHEN 0 THEN '38.9N 77.1W' WHEN 1 THEN '95.0 10' WHEN 2 THEN 'not collected' WHEN 3 THEN 'here' WHEN 4 THEN '' ELSE '-12.5 130.25' END AS lat_lon,
  CASE c_custkey % 6 WHEN 0 THEN '2020-05-06' WHEN 1 THEN '2020-05' WHEN 2 THEN '2020' WHEN 3 THEN '05/06/2020' WHEN 4 THEN 'missing' ELSE 'May 2020' END AS collection_date,
  CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'TRUE' END AS consent
FROM customer"""
_SW = {"sql": DIRTY_SAMPLES, "source": "customer", "key": "sample_id"}
_S = f"WITH dirty AS ({DIRTY_SAMPLES}), t AS (SELECT count(*) AS total FROM dirty) "
_add("pregnant_males", _rows(lambda r, n: samples.pregnant_males(r, "sex", "pregnant", n), **_SW), _S + _obs("cross_column_inconsistency", "'error'", "cross_column_validator", "SELECT 'sex vs pregnant' AS c, count(*) AS o FROM dirty WHERE lower(sex) IN ('male', 'm') AND lower(pregnant) = 'yes' HAVING count(*) > 0", "0.95"))
_add("young_patients", _rows(lambda r, n: samples.young_patients(r, "age", "diagnosis", n), **_SW), _S + _obs("cross_column_inconsistency", "'warning'", "cross_column_validator", "SELECT 'age vs diagnosis' AS c, count(*) AS o FROM dirty WHERE CAST(age AS INTEGER) <= 12 AND lower(diagnosis) = 'type 2 diabetes' HAVING count(*) > 0", "0.70"))
_PLACE = "lower(trim({0})) IN ('missing', 'not collected', 'not applicable', 'na') OR coalesce(TRY_CAST(regexp_extract({0}, '^([+-]?[0-9.]+)', 1) AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(regexp_extract({0}, ' ([+-]?[0-9.]+)', 1) AS DOUBLE) BETWEEN -180 AND 180, false)"
_DS = _d(["lat_lon", "collection_date", "consent"], DIRTY_SAMPLES, "sample_id")
_add("lat_lon_format", lambda s, d: samples.invalid_values(value_dictionary(_dirty(s, d, **_SW), ["lat_lon"]), "lat_lon", samples.latitude_longitude(F.col("value"))), _DS + f"SELECT c AS \"column\", CAST(sum(CASE WHEN {_PLACE.format('v')} THEN 0 ELSE n END) AS BIGINT) AS n_invalid, CAST(sum(n) AS BIGINT) AS n FROM d WHERE c = 'lat_lon' AND NOT missing GROUP BY c")
_add("collection_date_format", lambda s, d: samples.invalid_values(value_dictionary(_dirty(s, d, **_SW), ["collection_date"]), "collection_date", samples.collection_date(F.col("value"))), _DS + "SELECT c AS \"column\", CAST(sum(CASE WHEN v = 'missing' OR regexp_matches(v, '^(....-..-..|....-..|[0-9]{4})$') THEN 0 ELSE n END) AS BIGINT) AS n_invalid, CAST(sum(n) AS BIGINT) AS n FROM d WHERE c = 'collection_date' AND NOT missing GROUP BY c")
_add("many_booleans", lambda s, d: samples.many_booleans(value_dictionary(_dirty(s, d, **_SW), ["consent"]), ["consent"]), _DS + "SELECT c AS \"column\", count(DISTINCT trim(v)) AS spellings FROM d WHERE c = 'consent' AND trim(v) <> '' GROUP BY c HAVING count(DISTINCT trim(v)) > 2")
_READY = ["sex", "age", "diagnosis", "lat_lon", "collection_date"]
_add("readiness", lambda s, d: samples.readiness(_dirty(s, d, **_SW), _READY, "collection_date", "lat_lon"), f"WITH dirty AS ({DIRTY_SAMPLES}), g AS (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(f'lower(trim({c}))' for c in _READY)}), x AS (SELECT count(*) AS samples, count(*) FILTER (NOT regexp_matches(collection_date, '^[0-9]{{4}}(-[0-9]{{2}}(-[0-9]{{2}})?)?$')) AS n_bad_date, count(*) FILTER (lat_lon <> '' AND NOT ({_PLACE.format('lat_lon')})) AS n_bad_place FROM dirty), y AS (SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_duplicate FROM g) SELECT samples, n_duplicate, n_bad_date, n_bad_place, CAST(floor(greatest(0, 100 - (n_duplicate * 30 + n_bad_date * 10 + n_bad_place * 10) / CAST(samples AS DOUBLE))) AS INTEGER) AS score, n_duplicate = 0 AS is_ready FROM x, y")

# profiles beyond counts
_add("sample_values", lambda s, d: profile.sample_values(value_dictionary(_dirty(s, d), ["status", "priority"])), _d(["status", "priority"]) + 'SELECT c AS "column", list(v ORDER BY first_row) AS sample_values FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY first_row) AS k FROM d WHERE NOT missing) WHERE k <= 5 GROUP BY c')
_ORGANISM = DIRTY_SAMPLES.replace("FROM customer", ", CASE c_custkey % 6 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'homo sapiens' WHEN 2 THEN 'E. coli' WHEN 3 THEN 'unknown' WHEN 4 THEN 'Mus muscullus' ELSE 'Gallus gallus' END AS organism FROM customer")
_SUBMITTED = f"SELECT samples, n_duplicate, n_bad_date, n_bad_place, n_bad_organism, n_bad_null, CAST(0 AS BIGINT) AS n_mismatch, CAST(floor(greatest(0, 100 - (n_duplicate * 30 + n_bad_organism * 25 + n_bad_date * 10 + n_bad_place * 10 + n_bad_null * 5) / CAST(samples AS DOUBLE))) AS INTEGER) AS score, n_duplicate = 0 AND n_bad_organism = 0 AS is_ready FROM ({ORACLE_SQL['readiness']}), (SELECT count(*) FILTER (c_custkey % 6 NOT IN (0, 5)) AS n_bad_organism, count(*) FILTER (c_custkey % 5 NOT IN (0, 1)) + count(*) FILTER (c_custkey % 6 = 3) AS n_bad_null FROM customer)"
_add("submission_readiness", lambda s, d: samples.submission_readiness(_dirty(s, d, **_SW | {"sql": _ORGANISM}), _READY, "collection_date", "lat_lon", "organism"), _SUBMITTED)

_HINTED = "id,date,time,count,total,mean,avg,sum,min,max,std,var,pct,percent,num,name,type,status,group,category".split(",")


def _column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all columns of the tables, and some that are written in other ways."""
    names = [c for t in ("orders", "lineitem", "customer", "part", "events", "labels") for c in _table(spark, sf_dir, t).columns]
    return spark.createDataFrame([(c,) for c in dict.fromkeys([*names, *_ODD_NAMES])], "column string")


_ODD_NAMES = ["order_Date.total-x count", "Sample ID", "MEAN.value", "pct-group"]
_COLUMNS_SQL = "(SELECT DISTINCT column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'customer', 'part', 'events', 'labels') UNION SELECT unnest(" + str(_ODD_NAMES) + "))"
_add("name_hints", lambda s, d: _column_names(s, d).select("column", F.array_join(profile.name_hints(F.col("column")), ",").alias("hints")), f"SELECT \"column\", array_to_string(list_filter(regexp_split_to_array(lower(\"column\"), '[-_. ]'), lambda x: list_contains({_HINTED}, x)), ',') AS hints FROM {_COLUMNS_SQL}")
_add("constraints", lambda s, d: profile.constraints(value_dictionary(_dirty(s, d), ["status", "url"])), _d(["status", "url"]) + "SELECT c AS \"column\", count(*) FILTER (NOT missing) <= 20 AS in_set, count(*) FILTER (NOT missing) = sum(CASE WHEN missing THEN 0 ELSE n END) AND count(*) FILTER (NOT missing) > 0 AS is_unique, sum(CASE WHEN missing THEN n ELSE 0 END) = 0 AS not_null FROM d GROUP BY c")
_add("z_outliers", lambda s, d: profile.z_outliers(_table(s, d, "events"), "value"), "SELECT 'value' AS \"column\", count(*) AS occurrences FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs(value - m) / s > 3")

# decisions and summaries
_add("observation_cube", lambda s, d: decisions.rollup(_observations(s, d)), f"SELECT severity, type, count(*) AS n FROM ({_UNION}) GROUP BY CUBE (severity, type)")
_add("calibrated_confidence", lambda s, d: _observations(s, d).select("type", "column", decisions.calibrated("clinical").alias("calibrated")), f"SELECT type, \"column\", round(greatest(0, least(1, confidence + 0.1 + CASE WHEN type IN ('type_mismatch', 'constraint_violation') THEN CAST(0.1 AS DOUBLE) WHEN type = 'outlier' THEN CAST(-0.1 AS DOUBLE) ELSE 0 END + CASE WHEN occurrences > 5 THEN CAST(0.05 AS DOUBLE) ELSE 0 END)), 6) AS calibrated FROM ({_UNION})")


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    suggested = curation.suggestions(curation.number_observations(_observations(spark, sf_dir)))
    first = decisions.decide(suggested, None, decisions.ACCEPTED, action="standardize")
    return suggested, decisions.decide(suggested, first, decisions.REJECTED, column="PRICE")


_DECIDED = f"SELECT observation_id, CASE WHEN action = 'standardize' THEN 'accepted' WHEN lower(\"column\") = 'price' THEN 'rejected' END AS status FROM ({_SUGGEST}) WHERE action IS NOT NULL"
_add("batch_decisions", lambda s, d: _decided(s, d)[1], f"SELECT * FROM ({_DECIDED}) WHERE status IS NOT NULL")
_add("decision_progress", lambda s, d: decisions.progress(*_decided(s, d)), f"SELECT count(*) AS n, count(*) FILTER (status = 'accepted') AS n_accepted, count(*) FILTER (status = 'rejected') AS n_rejected, CAST(0 AS BIGINT) AS n_modified, count(*) FILTER (status IS NULL) AS n_pending, round(count(status) / CAST(count(*) AS DOUBLE), 6) AS progress FROM ({_DECIDED})")


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _observations(spark, sf_dir)
    seen = observed.agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    return seen.crossJoin(curation.quality_score(observed, len(TEXT))).select(decisions.recommendation(F.col("e"), F.col("w"), F.col("score")).alias("recommendation"))


_SCORE = f"SELECT greatest(0, least(1, 1 - count(DISTINCT \"column\") / CAST({len(TEXT)} AS DOUBLE) - least(0.5, CAST(0.1 AS DOUBLE) * count(*) FILTER (severity = 'error') + CAST(0.02 AS DOUBLE) * count(*) FILTER (severity = 'warning') + CAST(0.005 AS DOUBLE) * count(*) FILTER (severity = 'info')))) AS score FROM ({_UNION})"
_add("recommendation", _recommended, f"SELECT CASE WHEN e > 0 THEN 'Address ' || e || ' error-level issues before proceeding with analysis.' WHEN w > 5 THEN 'Review ' || w || ' warning-level issues to improve data quality (score: ' || CAST(round(score * 100) AS INTEGER) || '%).' ELSE 'Data quality is acceptable. Consider addressing warnings.' END AS recommendation FROM (SELECT count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM ({_UNION})), ({_SCORE})")

# places and checklists of samples
DIRTY_SITES = """
SELECT c_custkey AS site_id,
  CASE c_custkey % 9 WHEN 0 THEN '38.9N 77.1W' WHEN 1 THEN '95.0 10' WHEN 2 THEN 'not collected' WHEN 3 THEN 'here' WHEN 4 THEN '' WHEN 5 THEN '38:58:48;77:06:36' WHEN 6 THEN '12.5,190.25' WHEN 7 THEN 'n/a' ELSE '-12.5 130.25' END AS lat_lon,
  CASE c_custkey % 5 WHEN 0 THEN 'Human-Gut' WHEN 1 THEN 'stool' WHEN 2 THEN 'marine' WHEN 3 THEN 'elsewhere' ELSE 'plant associated' END AS package
FROM customer"""
_SITES = {"sql": DIRTY_SITES, "source": "customer", "key": "site_id"}
_DSITES = _d(["lat_lon", "package"], DIRTY_SITES, "site_id")


def _sites(kind: str, severity: str, values: str, confidence: str) -> str:
    return _obs(kind, f"'{severity}'", "coordinate_validator", f"SELECT c, sum(n) AS o FROM d WHERE c = 'lat_lon' AND v IN ({values}) GROUP BY c", confidence)


_add("combined_coordinates", _check(["lat_lon"], lambda v, n: V.combined_coordinates(v, "lat_lon", n), **_SITES), _DSITES + " UNION ALL ".join(f"({q})" for q in [
    _sites("outlier", "error", "'95.0 10', '12.5,190.25'", "0.95"), _sites("inconsistency", "warning", "'38.9N 77.1W', '95.0 10', '38:58:48;77:06:36', '12.5,190.25', '-12.5 130.25'", "0.85"),
    _sites("inconsistency", "warning", "'95.0 10'", "0.75"), _sites("pattern_violation", "warning", "'here'", "0.80")]))
_add("packages", lambda s, d: checklist.packages_of_samples(value_dictionary(_dirty(s, d, **_SITES), ["package"]), "package"), _DSITES + "SELECT CASE lower(v) WHEN 'human-gut' THEN 'human-gut' WHEN 'stool' THEN 'human-gut' WHEN 'marine' THEN 'water' ELSE 'plant-associated' END AS package, CAST(sum(n) AS BIGINT) AS n FROM d WHERE c = 'package' AND lower(v) IN ('human-gut', 'stool', 'marine', 'plant associated') GROUP BY 1")


def _listed(spark: SparkSession, sf_dir: str, names: list[str], column: str) -> DataFrame:
    """_row_id and a column in which every customer names one of some things."""
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_row_id"), pick.alias(column))


def _named(names: list[str], found: str, key: str) -> str:
    """Rows of a subquery and how many customers name their key."""
    quoted = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"SELECT x.*, named.n FROM ({found}) x JOIN (SELECT list_value({quoted})[c_custkey % {len(names)} + 1] AS v, count(*) AS n FROM customer GROUP BY 1) named ON named.v = x.\"{key}\""


_HELD = ["Sample-Date", "lat_lon", "Study Name", "patient_id", "age", "depth", "Country", "weight"]


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """column and n: the columns that a table of the parts of samples names."""
    return _listed(spark, sf_dir, _HELD, "column").groupBy("column").agg(F.count("*").alias("n"))


_MATCHED = "SELECT * FROM (VALUES ('Sample-Date', 'collection_date', 'mandatory'), ('lat_lon', 'lat_lon', 'mandatory'), ('Study Name', 'project_name', 'mandatory'), ('patient_id', 'host_subject_id', 'mandatory'), ('age', 'host_age', 'recommended'), ('Country', 'geo_loc_name', 'mandatory')) t(\"column\", field, requirement)"
_add("checklist_columns", lambda s, d: checklist.matched(h := _held(s, d), "human-gut").join(h, "column"), _named(_HELD, _MATCHED, "column"))
_add("checklist_compliance", lambda s, d: checklist.compliance(h := _held(s, d), "human-gut").crossJoin(checklist.matched(h, "human-gut").filter("requirement = 'mandatory'").join(h, "column").agg(F.sum("n").alias("rows"))), f"SELECT CAST(10 AS BIGINT) AS n_mandatory, CAST(5 AS BIGINT) AS n_found, CAST(0.5 AS DOUBLE) AS score, CAST(sum(n) AS BIGINT) AS rows FROM ({_named(_HELD, _MATCHED, 'column')}) WHERE requirement = 'mandatory'")
_add("checklist_missing", lambda s, d: checklist.missing_fields(_held(s, d), "soil", _table(s, d, "customer").count()), "WITH t AS (SELECT count(*) AS total FROM customer) " + _obs("completeness", "'error'", "mixs_compliance", "SELECT unnest(['investigation_type', 'env_broad_scale', 'env_local_scale', 'env_medium', 'elev']) AS c, (SELECT total FROM t) AS o"))
_add("json_rows", lambda s, d: _dirty(s, d).select("_row_id", delimited.typed_json(["status", "price", "answer"]).alias("json")).withColumnRenamed("_row_id", "order_id"), f"SELECT order_id, '{{\"status\":' || CASE WHEN trim(status) = '' THEN 'null' ELSE '\"' || status || '\"' END || ',\"price\":' || CASE WHEN price = 'n/a' THEN 'null' WHEN price = 'abc' THEN '\"abc\"' ELSE price END || ',\"answer\":\"' || answer || '\"}}' AS json FROM ({DIRTY_ORDERS})")


# inference beyond counts
_CODES = """
SELECT c_custkey AS row_id, lpad(CAST(c_custkey % 10000 AS STRING), 5, '0') AS digits, CASE WHEN c_custkey % 3 = 0 THEN 'ABC' ELSE 'XYZ' END AS letters,
  concat('ab-', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')) AS mixed, CASE WHEN c_custkey % 50 = 7 THEN 'X1' ELSE concat('S', lpad(CAST(c_custkey % 900 AS STRING), 3, '0')) END AS most,
  CASE c_custkey % 4 WHEN 0 THEN '-1' WHEN 1 THEN '999' WHEN 2 THEN 'n/a' ELSE 'x y' END AS odd, concat('u', CAST(c_custkey AS STRING), '@example.org') AS contact
FROM customer"""
_CW = {"sql": _CODES, "source": "customer", "key": "row_id"}
_CCOLS = ["digits", "letters", "mixed", "most", "odd", "contact"]
_DC = _d(_CCOLS, _CODES, "row_id")
_MINED = "SELECT 'digits' AS c, '^\\d{5}$' AS pattern, CAST(1 AS DOUBLE) AS score UNION ALL SELECT 'letters', '^[A-Z]{3}$', 1 UNION ALL SELECT 'mixed', '^[a-z]{2}-\\d{3}$', 1 UNION ALL SELECT 'most', '^[A-Z]\\d{3}$', round(sum(CASE WHEN v = 'X1' THEN 0 ELSE n END) / CAST(sum(n) AS DOUBLE), 6) FROM d WHERE c = 'most'"
_add("value_patterns", lambda s, d: inference.value_patterns(value_dictionary(_dirty(s, d, **_CW), _CCOLS)), _DC + f'SELECT c AS "column", pattern, score FROM ({_MINED})')
_add("kept_value_counts", lambda s, d: inference.kept_counts(value_dictionary(_dirty(s, d), TEXT)), _d(TEXT) + 'SELECT c AS "column", v AS value, n FROM d WHERE NOT missing AND c IN (SELECT c FROM d WHERE NOT missing GROUP BY c HAVING count(*) <= 40)')
_add("missing_statistics", lambda s, d: inference.missing_statistics(value_dictionary(_dirty(s, d, **_CW), _CCOLS)), _DC + "SELECT c AS \"column\", v AS pattern, CAST(n AS BIGINT) AS n FROM d WHERE v IN ('-1', '999', '9999') AND n >= 2")
_DTYPE = f"k AS (SELECT c, {_TYPE} AS t, sum(n) AS n FROM d WHERE NOT missing GROUP BY 1, 2), w AS (SELECT c, arg_max(t, n * 10 - list_position(['integer','float','boolean','date','datetime','string'], t)) AS t0, max(n) AS n, sum(n) AS total, max(CASE WHEN t = 'float' THEN 1 ELSE 0 END) AS floats FROM k GROUP BY c), y AS (SELECT c, CASE WHEN t0 = 'integer' AND floats = 1 THEN 'float' ELSE t0 END AS t, CAST(n AS DOUBLE) / total * CASE WHEN t0 = 'integer' AND floats = 1 THEN CAST(0.95 AS DOUBLE) ELSE 1 END AS sure FROM w)"
_DSEM = _DTYPE + f", x AS (SELECT c, count(*) FILTER (NOT missing) AS k, sum(CASE WHEN missing THEN n ELSE 0 END) AS gone, sum(n) AS total, min(CASE WHEN regexp_matches(v, '{_NUMBER}') THEN CAST(v AS DOUBLE) END) AS low, max(CASE WHEN regexp_matches(v, '{_NUMBER}') THEN CAST(v AS DOUBLE) END) AS high FROM d GROUP BY c), z AS (SELECT x.c, t, sure, k, gone > 0 AS nullable, k = total - gone AND k > 0 AS is_unique, low, high, CASE WHEN t = 'boolean' THEN 'binary' WHEN t = 'integer' AND low >= 0 THEN 'count' WHEN t IN ('integer', 'float') AND low >= 0 AND high <= 1 THEN 'proportion' WHEN t <> 'string' THEN 'continuous' WHEN k = 2 THEN 'binary' WHEN k <= 20 THEN 'categorical' WHEN k = total THEN 'identifier' ELSE 'free_text' END AS semantic_type FROM x JOIN y USING (c))"
_add("semantic_types", lambda s, d: inference.semantic_types(value_dictionary(_dirty(s, d, **_CW), _CCOLS)).select("column", "inferred_type", "semantic_type", "is_unique", "nullable"), _DC.rstrip() + f", {_DSEM} SELECT c AS \"column\", t AS inferred_type, semantic_type, is_unique, nullable FROM z")
_RULES = f"SELECT c, 'set' AS kind, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS VARCHAR) AS pattern, CAST(0.9 AS DOUBLE) AS confidence FROM z WHERE semantic_type IN ('categorical', 'binary') AND k <= 20 UNION ALL SELECT c, 'range', low, high, NULL, 0.85 FROM z WHERE t IN ('integer', 'float') UNION ALL SELECT c, 'unique', NULL, NULL, NULL, 0.95 FROM z WHERE is_unique UNION ALL SELECT c, 'not_null', NULL, NULL, NULL, 0.9 FROM z WHERE NOT nullable UNION ALL SELECT c, 'pattern', NULL, NULL, pattern, score FROM ({_MINED})"
_add("inferred_constraints", lambda s, d: inference.inferred_constraints(value_dictionary(_dirty(s, d, **_CW), _CCOLS)), _DC.rstrip() + f", {_DSEM} SELECT c AS \"column\", kind, low, high, pattern, confidence FROM ({_RULES})")
_ROLED = "CASE c WHEN 'contact' THEN 'identifier' ELSE 'unknown' END"
_add("fused_schema", lambda s, d: inference.fused(value_dictionary(_dirty(s, d, **_CW), _CCOLS)), _DC.rstrip() + f", {_DSEM}, rules AS ({_RULES}), f AS (SELECT z.*, {_ROLED} AS role, ((CASE c WHEN 'contact' THEN CAST(0.6 AS DOUBLE) ELSE 0 END) + coalesce(score, 0)) / 2 AS semantic, (SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM rules WHERE rules.c = z.c AND confidence >= 0.7) AS kinds FROM z LEFT JOIN ({_MINED}) m USING (c)) SELECT c AS \"column\", t AS inferred_type, semantic_type, CASE WHEN semantic <= 0.6 AND is_unique AND NOT nullable THEN 'identifier' ELSE role END AS role, nullable, is_unique, coalesce(kinds, '') AS constraints, round(sure * CAST(0.6 AS DOUBLE) + semantic * CAST(0.4 AS DOUBLE), 4) AS confidence, CASE WHEN semantic > 0.3 THEN 'statistical,semantic' ELSE 'statistical' END AS sources FROM f")
_QUART = ", ".join(f"max(CASE WHEN k = floor({p} * (n - 1) + 0.5) THEN v END) AS {q}" for p, q in ((0.25, "q1"), (0.75, "q3")))
_add("far_values", lambda s, d: inference.far_values(_table(s, d, "events"), "value"), f"WITH r AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), q AS (SELECT {_QUART}, avg(v) AS m, stddev_pop(v) AS s FROM r), b AS (SELECT v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) AS i, abs(v - m) / s > 3 AS z FROM r, q) SELECT 'value' AS \"column\", count(*) FILTER (i) AS n_iqr, count(*) FILTER (z) AS n_z, count(*) FILTER (i OR z) AS occurrences FROM b")

_add("schema_selects", lambda s, d: schema.table_schema(value_dictionary(_dirty(s, d, **_CW), _CCOLS), _CCOLS).select("column", "position", "role", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in (("name", schema.is_named("digits")), ("position", schema.is_at(2)), ("role", schema.has_role("identifier")), ("identifier", schema.is_identifier()))]))).alias("asked")), "WITH s AS (SELECT f.\"column\", position, role, is_unique, nullable FROM (" + ORACLE_SQL["fused_schema"] + ") f JOIN (VALUES ('digits', 0), ('letters', 1), ('mixed', 2), ('most', 3), ('odd', 4), ('contact', 5)) p(c, position) ON f.\"column\" = c) " + " UNION ALL ".join(f"SELECT \"column\", position, role, '{k}' AS asked FROM s WHERE {w}" for k, w in (("name", "\"column\" = 'digits'"), ("position", "position = 2"), ("role", "role = 'identifier'"), ("identifier", "role = 'identifier' AND is_unique AND NOT nullable"))))
_MOMENTS = ["price", "latitude", "status"]
_RANKED = f"r AS (SELECT c, CAST(v AS DOUBLE) AS x, sum(n) AS n FROM d WHERE NOT missing AND regexp_matches(v, '{_NUMBER}') GROUP BY 1, 2), k AS (SELECT c, x, n, sum(n) OVER (PARTITION BY c ORDER BY x) AS upto, sum(n) OVER (PARTITION BY c) AS all_n FROM r), m AS (SELECT c, sum(x * n) / sum(n) AS mean FROM k GROUP BY c)"
_AT = ", ".join(f"min(CASE WHEN upto > floor({p} * (all_n - 1) + 0.5) THEN x END) AS {q}" for p, q in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
_add("text_moments", lambda s, d: inference.text_moments(value_dictionary(_dirty(s, d), _MOMENTS)).select("column", "n", "low", "high", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "q1", "median", "q3"), _d(_MOMENTS).rstrip() + f", {_RANKED} SELECT k.c AS \"column\", CAST(max(all_n) AS BIGINT) AS n, min(x) AS low, max(x) AS high, round(max(mean), 4) AS mean, round(sqrt(sum(n * (x - mean) * (x - mean)) / max(all_n)), 4) AS std, {_AT} FROM k JOIN m ON m.c = k.c GROUP BY k.c")

# columns of life science
_SCIENCE = ["organism", "host_taxid", "Sample_Species", "order", "env_broad_scale", "my_env_scale_2", "body_site_left", "tissue", "diagnosis", "health_status", "biosample_accession", "sample_accession", "run_accession", "accession", "uniprot", "gene_id", "terror", "price", "age"]


def _science(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, _SCIENCE, "column").groupBy("column").agg(F.count("*").alias("n"))


_add("column_kinds", lambda s, d: _science(s, d).select("column", "n", domain.holds_organisms(F.col("column")).alias("organisms"), domain.ontology_of(F.col("column")).alias("ontology"), domain.accession_of(F.col("column")).alias("accession")), _named(_SCIENCE, "SELECT * FROM (VALUES ('organism', true, NULL, NULL), ('host_taxid', true, NULL, NULL), ('Sample_Species', true, NULL, NULL), ('order', true, NULL, NULL), ('env_broad_scale', false, 'ENVO', NULL), ('my_env_scale_2', false, 'ENVO', NULL), ('body_site_left', false, 'UBERON', NULL), ('tissue', false, 'UBERON', NULL), ('diagnosis', false, 'MONDO', NULL), ('health_status', false, 'MONDO', NULL), ('biosample_accession', false, NULL, 'biosample'), ('sample_accession', false, NULL, 'biosample'), ('run_accession', false, NULL, 'sra_run'), ('accession', false, NULL, 'genbank'), ('uniprot', false, NULL, 'uniprot'), ('gene_id', false, NULL, 'gene_id'), ('terror', false, NULL, 'sra_run'), ('price', false, NULL, NULL), ('age', false, NULL, NULL)) t(\"column\", organisms, ontology, accession)", "column"))


def _organisms(kind: str, severity: str, value: str, sure: str) -> str:
    return "SELECT * FROM (" + _obs(kind, f"'{severity}'", "taxonomy_validator", f"SELECT c, sum(n) AS o FROM d WHERE c = 'organism' AND v = '{value}' GROUP BY c", sure) + ")"


_add("organism_checks", _check(["organism"], lambda v, n: domain.organism_observations(v, "organism", n), **_PEOPLE), _d(["organism"], DIRTY_PEOPLE, "person_id") + " UNION ALL ".join([_organisms("inconsistency", "warning", "E. coli", "0.95"), _organisms("inconsistency", "warning", "homo sapiens", "0.9"), _organisms("inconsistency", "warning", "Mus muscullus", "0.7")]))
_add("organism_nearest", lambda s, d: taxonomy.nearest(value_dictionary(_dirty(s, d, **_PEOPLE), ["organism"]), "organism"), f"WITH dirty AS ({DIRTY_PEOPLE}), names(name) AS (VALUES {_NAMES}), o AS (SELECT DISTINCT organism AS value FROM dirty) SELECT value, arg_min(name, (e, name)) AS name, CAST(min(e) AS INTEGER) AS edits FROM (SELECT value, name, levenshtein(lower(value), lower(name)) AS e FROM o, names) WHERE e <= 3 GROUP BY value")
_add("accession_checks", _check(["accession"], lambda v, n: domain.accession_observations(v, "accession", "genbank", n), **_PEOPLE), _d(["accession"], DIRTY_PEOPLE, "person_id") + _obs("pattern_violation", "'warning'", "accession_validator", f"SELECT c, sum(n) AS o FROM d WHERE {_ACC} <> 'genbank' GROUP BY c", "0.9"))
_add("accession_urls", lambda s, d: _dirty(s, d, **_PEOPLE).select(F.col("_row_id").alias("person_id"), domain.accession_url(F.col("accession")).alias("url")), f"SELECT person_id, CASE accession WHEN 'SAMN00000001' THEN 'https://www.ncbi.nlm.nih.gov/biosample/SAMN00000001' WHEN 'srr123456' THEN 'https://www.ncbi.nlm.nih.gov/sra/SRR123456' WHEN 'NM_000014.5' THEN 'https://www.ncbi.nlm.nih.gov/nuccore/NM_000014.5' WHEN 'P12345' THEN 'https://www.uniprot.org/uniprotkb/P12345' WHEN '1ABC' THEN 'https://www.rcsb.org/structure/1ABC' WHEN '12345' THEN 'https://www.ncbi.nlm.nih.gov/gene/12345' WHEN 'PRJNA1234' THEN 'https://www.ncbi.nlm.nih.gov/bioproject/PRJNA1234' END AS url FROM ({DIRTY_PEOPLE})")
_TERMS = [("ENVO:00000446", "terrestrial biome", ["land biome"]), ("ENVO:00000447", "marine biome", ["ocean biome"]), ("ENVO:00002007", "sediment", [])]
DIRTY_BIOMES = """
SELECT c_custkey AS biome_id, CASE c_custkey % 9 WHEN 0 THEN 'ENVO:00000446' WHEN 1 THEN 'envo:00000447' WHEN 2 THEN 'ENVO:99999999' WHEN 3 THEN 'XYZ:1' WHEN 4 THEN 'Marine Biome' WHEN 5 THEN 'ocean biome' WHEN 6 THEN 'biome marine' WHEN 7 THEN 'moon base' ELSE 'missing' END AS biome
FROM customer"""
_BW = {"sql": DIRTY_BIOMES, "source": "customer", "key": "biome_id"}
_DB = _d(["biome"], DIRTY_BIOMES, "biome_id")


def _terms(values: DataFrame) -> DataFrame:
    return values.sparkSession.createDataFrame(_TERMS, "id string, label string, synonyms array<string>")


_add("term_status", lambda s, d: domain.term_status(v := value_dictionary(_dirty(s, d, **_BW), ["biome"]), "biome", _terms(v)), _DB + "SELECT v AS value, CAST(n AS BIGINT) AS n, s AS status, i AS id FROM d JOIN (VALUES ('ENVO:00000446', 'valid', 'ENVO:00000446'), ('envo:00000447', 'valid', 'ENVO:00000447'), ('ENVO:99999999', 'unknown_term', NULL), ('XYZ:1', 'invalid_format', NULL), ('Marine Biome', 'mapped', 'ENVO:00000447'), ('ocean biome', 'mapped', 'ENVO:00000447'), ('biome marine', 'mapped', 'ENVO:00000447'), ('moon base', 'unmapped', NULL)) t(v, s, i) USING (v)")


def _biomes(kind: str, severity: str, values: str, sure: str) -> str:
    return "SELECT * FROM (" + _obs(kind, f"'{severity}'", "ontology_validator", f"SELECT c, sum(n) AS o FROM d WHERE v IN ({values}) GROUP BY c", sure) + ")"


_add("ontology_checks", _check(["biome"], lambda v, n: domain.ontology_observations(v, "biome", _terms(v), n), **_BW), _DB + " UNION ALL ".join([_biomes("inconsistency", "warning", "'Marine Biome', 'ocean biome', 'biome marine'", "0.8"), _biomes("constraint_violation", "info", "'moon base'", "0.5"), _biomes("pattern_violation", "error", "'ENVO:99999999', 'XYZ:1'", "0.9")]))
_BODIES = "SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 3 = 0 THEN 'Stool sample' ELSE 'elsewhere' END AS body_site, '1' AS ph FROM customer"
_add("detected_package", lambda s, d: domain.detected_package(rows := _dirty(s, d, sql=_BODIES, source="customer", key="subject_id"), ["subject_id", *rows.columns[1:]]), f"SELECT coalesce(arg_min('human-gut', subject_id) FILTER (contains(body_site, 'Stool')), 'human-associated') AS package FROM (SELECT * FROM ({_BODIES}) ORDER BY subject_id LIMIT 10)")
_add("readiness_findings", lambda s, d: domain.readiness_observations(QUERIES["readiness"](s, d)), f"SELECT type, severity, \"column\", 'sample_validator' AS detector, confidence, o AS occurrences, round(o * CAST(100 AS DOUBLE) / samples, 4) AS percentage FROM (SELECT samples, unnest(['inconsistency', 'pattern_violation', 'pattern_violation']) AS type, unnest(['error', 'warning', 'warning']) AS severity, unnest(['duplicate', 'bad_date', 'bad_place']) AS \"column\", unnest([CAST(0.95 AS DOUBLE), 0.85, 0.85]) AS confidence, unnest([n_duplicate, n_bad_date, n_bad_place]) AS o FROM ({ORACLE_SQL['readiness']})) WHERE o > 0")


_LOOKED = [("human", "case_error", "Homo sapiens"), ("Homo sapiens", "valid", "Homo sapiens"), ("HIV", "case_error", "Human immunodeficiency virus 1"), ("L. reuteri", "case_error", "Lactobacillus reuteri"), ("C difficile", "abbreviation", "Clostridioides difficile"), ("candida", "case_error", "Candida"), ("Zea may", "possible_typo", "Zea mays"), ("rocks", "unknown", None)]
_ASKED = [name for name, _, _ in _LOOKED]


def _looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.match(value_dictionary(_listed(spark, sf_dir, _ASKED, "organism")), "organism")


_add("organism_lookup", _looked_up, _named(_ASKED, "SELECT * FROM (VALUES ('human', 'case_error', 'Homo sapiens'), ('Homo sapiens', 'valid', 'Homo sapiens'), ('HIV', 'case_error', 'Human immunodeficiency virus 1'), ('L. reuteri', 'case_error', 'Lactobacillus reuteri'), ('C difficile', 'abbreviation', 'Clostridioides difficile'), ('candida', 'case_error', 'Candida'), ('Zea may', 'possible_typo', 'Zea mays'), ('rocks', 'unknown', NULL)) t(value, status, name)", "value"))
_TAXIDS = ["9606", " 10090", "562", "7", "x9"]
_add("taxid_lookup", lambda s, d: taxonomy.by_taxid(value_dictionary(_listed(s, d, _TAXIDS, "taxid")), "taxid"), "SELECT taxid, count(*) AS n, name, rank FROM customer JOIN (VALUES (0, 9606, 'Homo sapiens', 'species'), (1, 10090, 'Mus musculus', 'species'), (2, 562, 'Escherichia coli', 'species'), (3, 7, NULL, NULL)) t(k, taxid, name, rank) ON c_custkey % 5 = k GROUP BY taxid, name, rank")
_TEXTS = ["Prairie", "ocean biome", "forest", "colitis ulcerative", "nothing known", "lung carcinoma", "asthma"]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir, _TEXTS, "value").groupBy("value").agg(F.count("*").alias("n"))


_ENVO = "SELECT value, id, CAST(c AS DOUBLE) AS confidence FROM (VALUES ('Prairie', 'ENVO:01000177', 0.95), ('ocean biome', 'ENVO:00000447', 0.95), ('forest', 'ENVO:01000174', 0.95)) t(value, id, c)"
_add("term_lookup", lambda s, d: domain.suggest((t := _texts(s, d)).select("value"), terms.terms(s).filter("id LIKE 'ENVO:%'")).join(t, "value"), _named(_TEXTS, _ENVO, "value"))
_add("term_counts", lambda s, d: terms.by_ontology(domain.suggest(_texts(s, d).filter("value <> 'colitis ulcerative'").select("value"), terms.terms(s))), "SELECT ontology, CAST(n AS BIGINT) AS n FROM (VALUES ('ENVO', 3), ('MONDO', 2)) t(ontology, n) WHERE EXISTS (SELECT 1 FROM customer)")
_add("science_report", lambda s, d: domain.column_observations(v := value_dictionary(rows := _dirty(s, d, **_PEOPLE)), rows.columns[1:], rows.count(), terms.terms(s)), f"SELECT * FROM ({ORACLE_SQL['organism_checks']}) UNION ALL SELECT * FROM ({ORACLE_SQL['accession_checks']})")
_add("organism_ranks", lambda s, d: taxonomy.by_rank(taxonomy.names(s).join(_looked_up(s, d).select("name"), "name", "left_semi")), "SELECT rank, CAST(n AS BIGINT) AS n FROM (VALUES ('species', 5), ('genus', 1)) t(rank, n) WHERE EXISTS (SELECT 1 FROM customer)")
_add("table_page", lambda s, d: values.page(_dirty(s, d), 200, 1000).select(F.col("_row_id").alias("order_id"), "status", "total_rows", "has_more"), f"SELECT order_id, status, total_rows, total_rows > 700 AS has_more FROM (SELECT order_id, status, count(*) OVER () AS total_rows, row_number() OVER (ORDER BY order_id) AS k FROM ({DIRTY_ORDERS})) WHERE k BETWEEN 201 AND 700")


# suggestions for each kind of observation
_KINDS = ["unique_violation", "identifier_duplicates", "completeness", "pregnant_males", "date_order", "bmi", "url_pattern", "title_case", "mixed_dates", "latitude_range", "range_violation"]


def _suggested_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = reduce(DataFrame.unionByName, (QUERIES[n](spark, sf_dir) for n in _KINDS))
    observed = curation.number_observations(observed)
    return apply.parameters(curation.suggestions(observed), observed).select("observation_id", "column", "action", "priority", "flag_column", "flag_value")


_KINDS_UNION = " UNION ALL ".join(f"(SELECT type, severity, \"column\", detector, occurrences, percentage FROM ({ORACLE_SQL[n]}))" for n in _KINDS)
_KIND_ACTION = "CASE WHEN detector = 'date_format_validator' THEN 'convert_date' WHEN type = 'inconsistency' THEN 'standardize' ELSE 'flag' END AS action, CAST(CASE type WHEN 'duplicate' THEN 1 WHEN 'pattern_violation' THEN 3 WHEN 'completeness' THEN 4 WHEN 'outlier' THEN CASE severity WHEN 'error' THEN 2 ELSE 4 END ELSE 2 END AS INTEGER) AS priority"
_KIND_FLAG = "CASE type WHEN 'cross_column_inconsistency' THEN 'cross_column_issue' WHEN 'duplicate' THEN \"column\" || '_duplicate' WHEN 'pattern_violation' THEN \"column\" || '_invalid_format' WHEN 'outlier' THEN \"column\" || '_flagged' END AS flag_column, CASE WHEN type = 'outlier' THEN CASE severity WHEN 'error' THEN 'invalid_value' ELSE 'outlier' END WHEN type NOT IN ('inconsistency', 'completeness') THEN type END AS flag_value"
_add("suggestion_kinds", _suggested_kinds, f"SELECT observation_id, \"column\", {_KIND_ACTION}, {_KIND_FLAG} FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, detector, \"column\", type, occurrences) AS observation_id FROM ({_KINDS_UNION})) WHERE type <> 'completeness' OR percentage >= 20")

# from decisions to the curated table
def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, suggestions and decisions: whatever standardizes, coerces or empties is accepted."""
    observed = curation.number_observations(_observations(spark, sf_dir)).persist()
    suggested = curation.suggestions(observed)
    decided = None
    for action in ("standardize", "coerce", "convert_na"):
        decided = decisions.decide(suggested, decided, decisions.ACCEPTED, action=action)
    return observed, suggested, decided


def _curated(spark: SparkSession, sf_dir: str) -> apply.Curated:
    observed, suggested, decided = _planned(spark, sf_dir)
    rows = _dirty(spark, sf_dir)
    plan = apply.resolved(decided, suggested, observed)
    return apply.apply_decided(rows, plan, apply.mappings(value_dictionary(rows, ["status", "price", "priority", "answer"])), {"price": "integer"})


_GROUPS = "SELECT c, lower(trim(v)) AS g, trim(v) AS v, sum(n) AS n FROM d WHERE NOT missing AND c IN ('status', 'priority') GROUP BY 1, 2, 3 UNION ALL SELECT c, CASE WHEN v IN ('yes', 'Y') THEN 'yes' WHEN v IN ('no', 'N') THEN 'no' ELSE 'mild' END, v, n FROM d WHERE c = 'answer'"
_MAPPED = f"m AS (SELECT c, v, first_value(v) OVER (PARTITION BY c, g ORDER BY n DESC, v) AS new FROM ({_GROUPS})), gone AS (SELECT c, lower(trim(v)) AS token FROM d WHERE c IN ('status', 'price') AND lower(trim(v)) IN ('missing', '999', '9999', '-999', '-9999') GROUP BY 1, 2 HAVING sum(n) >= 2)"
_CURED = _d(["status", "price", "priority", "answer"]).rstrip() + f", {_MAPPED}, cured AS (SELECT order_id, dirty.status AS status0, dirty.price AS price0, dirty.priority AS priority0, dirty.answer AS answer0, coalesce(a.new, dirty.status) AS status1, coalesce(b.new, dirty.priority) AS priority, coalesce(e.new, dirty.answer) AS answer, CASE WHEN dirty.price IN ('abc', '12.5') OR lower(dirty.price) IN (SELECT token FROM gone WHERE c = 'price') THEN '' ELSE dirty.price END AS price FROM dirty LEFT JOIN m a ON a.c = 'status' AND a.v = dirty.status LEFT JOIN m b ON b.c = 'priority' AND b.v = dirty.priority LEFT JOIN m e ON e.c = 'answer' AND e.v = dirty.answer), done AS (SELECT *, CASE WHEN lower(status1) IN (SELECT token FROM gone WHERE c = 'status') THEN '' ELSE status1 END AS status FROM cured) "
_add("curated_table", lambda s, d: _curated(s, d).rows.select(F.col("_row_id").alias("order_id"), "status", "price", "priority", "answer"), _CURED + "SELECT order_id, status, price, priority, answer FROM done")
_add("curated_log", lambda s, d: apply.change_log(_curated(s, d).audit), _CURED + "SELECT \"column\", reason, count(*) AS cells, count(*) AS rows FROM (SELECT 'status' AS \"column\", 'standardize' AS reason FROM done WHERE status0 <> status1 UNION ALL SELECT 'status', 'convert_na' FROM done WHERE status1 <> status UNION ALL SELECT 'priority', 'standardize' FROM done WHERE priority0 <> priority UNION ALL SELECT 'answer', 'standardize' FROM done WHERE answer0 <> answer UNION ALL SELECT 'price', CASE WHEN price0 IN ('abc', '12.5') THEN 'coerce' ELSE 'convert_na' END FROM done WHERE price0 <> price) GROUP BY 1, 2")
_PARAMS = f"SELECT s.observation_id, s.action, CASE WHEN s.action = 'flag' THEN s.\"column\" || CASE type WHEN 'outlier' THEN '_flagged' WHEN 'type_mismatch' THEN '_type_error' WHEN 'constraint_violation' THEN '_constraint_violation' END END AS flag_column, CASE WHEN type = 'missing_pattern' THEN split_part(s.\"column\", '=', 1) ELSE s.\"column\" END AS target, CASE WHEN type = 'missing_pattern' THEN split_part(s.\"column\", '=', 2) END AS pattern, round(confidence * CASE WHEN s.action = 'coerce' THEN CAST(0.9 AS DOUBLE) ELSE 1 END, 6) AS confidence, occurrences AS affected_rows FROM ({_SUGGEST}) s JOIN ({_NUMBERED}) o USING (observation_id) WHERE s.action IS NOT NULL"


def _parametrized(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed, suggested, _ = _planned(spark, sf_dir)
    return apply.parameters(suggested, observed).select("observation_id", "action", "flag_column", "target", "pattern", F.round("confidence", 6).alias("confidence"), "affected_rows")


def _previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed, suggested, decided = _planned(spark, sf_dir)
    return apply.preview(decided, suggested, observed)


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed, suggested, decided = _planned(spark, sf_dir)
    return apply.status_report(observed, suggested, decided, len(TEXT))


_add("suggestion_parameters", _parametrized, _PARAMS)
_add("decision_preview", _previewed, f"SELECT s.observation_id, s.\"column\", s.action, type, detector, occurrences AS affected_rows FROM ({_SUGGEST}) s JOIN ({_NUMBERED}) o USING (observation_id) WHERE s.action IN ('standardize', 'coerce', 'convert_na')")
_ACC_N = "count(*) FILTER (action IN ('standardize', 'coerce', 'convert_na'))"
_add("status_report", _reported, f"SELECT 'observations' AS measure, severity AS key, CAST(count(*) AS DOUBLE) AS value FROM ({_UNION}) GROUP BY severity UNION ALL SELECT measure, key, value FROM (SELECT unnest(['suggestions', 'decisions', 'decisions', 'decisions', 'decisions', 'progress']) AS measure, unnest(['all', 'accepted', 'rejected', 'modified', 'pending', 'all']) AS key, unnest([CAST(count(*) AS DOUBLE), {_ACC_N}, 0, 0, count(*) - {_ACC_N}, round({_ACC_N} / CAST(count(*) AS DOUBLE), 6)]) AS value FROM ({_SUGGEST}) WHERE action IS NOT NULL) UNION ALL SELECT 'score', 'all', round(score, 6) FROM ({_SCORE})")
_add("observation_profiles", lambda s, d: apply.with_profile(QUERIES["case_variants"](s, d).select("column", "detector"), inference.semantic_types(value_dictionary(_dirty(s, d), TEXT)).withColumn("semantic_role", profile.role_of(F.col("column")))), f"SELECT f.\"column\", detector, 'string' AS inferred_type, 'categorical' AS semantic_type, {_ROLE.replace(chr(34) + 'column' + chr(34), 'f.' + chr(34) + 'column' + chr(34))} AS semantic_role FROM ({ORACLE_SQL['case_variants']}) f")


# texts about columns and observations
def _told(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Numbered observations and the profile of their columns."""
    return curation.number_observations(_observations(spark, sf_dir)), profile.schema_profile(value_dictionary(_dirty(spark, sf_dir), TEXT))


_BASE = "split_part(\"column\", '=', 1)"
_WHY = f"""CASE type WHEN 'missing_pattern' THEN '''' || {_BASE} || ''' spells missing data as ordinary text, which analyses of clinical would count as values.'
  WHEN 'inconsistency' THEN '''' || {_BASE} || ''' (' || t || ') writes the same thing in more than one way, so groups of it fall apart.'
  WHEN 'outlier' THEN '''' || {_BASE} || ''' (' || t || ') has values far from the others: slips of entry, or rare cases that are right.'
  WHEN 'type_mismatch' THEN '''' || {_BASE} || ''' is mostly ' || t || ', but some of its values cannot be read as that.'
  ELSE '''' || {_BASE} || ''' has a finding of kind ' || type || ' that may lower the quality of the data; see its evidence.' END"""
_add("explained_observations", lambda s, d: explain.explained(*_told(s, d), "clinical").select("observation_id", "type", "column", "explanation"), f"SELECT observation_id, type, \"column\", {_WHY} AS explanation FROM (SELECT n.*, coalesce(v.inferred_type, 'unknown') AS t FROM ({_NUMBERED}) n LEFT JOIN ({ORACLE_SQL['type_vote']}) v ON v.\"column\" = split_part(n.\"column\", '=', 1))")
_DO = f"""CASE type WHEN 'missing_pattern' THEN 'Turn the spellings of missing data in ''' || {_BASE} || ''' into nulls.'
  WHEN 'outlier' THEN 'Look at the far values of ''' || {_BASE} || ''' before trusting them.'
  WHEN 'type_mismatch' THEN 'Read ''' || {_BASE} || ''' as its type, and look at what cannot be read.'
  WHEN 'completeness' THEN 'Say why ''' || {_BASE} || ''' has gaps, or fill them. Percent missing: ' || round(percentage, 1) || '.'
  WHEN 'inconsistency' THEN CASE detector WHEN 'case_variant_validator' THEN 'Write ''' || {_BASE} || ''' in one case.' WHEN 'semantic_equivalence_validator' THEN 'Use one word for each meaning in ''' || {_BASE} || '''.' ELSE 'Write the values of ''' || {_BASE} || ''' in one way.' END END"""
_PROPOSED = f"SELECT observation_id, CASE type WHEN 'missing_pattern' THEN 'convert_na' WHEN 'inconsistency' THEN 'standardize' WHEN 'type_mismatch' THEN 'coerce' ELSE 'flag' END AS action, CAST(CASE type WHEN 'missing_pattern' THEN 2 WHEN 'outlier' THEN 4 ELSE 3 END AS INTEGER) AS priority, CAST(CASE type WHEN 'missing_pattern' THEN 0.9 WHEN 'inconsistency' THEN 0.85 WHEN 'type_mismatch' THEN 0.75 ELSE 0.7 END AS DOUBLE) AS confidence, {_DO} AS rationale FROM ({_NUMBERED}) WHERE type IN ('missing_pattern', 'inconsistency', 'outlier', 'type_mismatch', 'completeness')"
_add("proposed_fixes", lambda s, d: explain.proposals(_told(s, d)[0]), _PROPOSED)


def _merged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' suggestions with those of the explainer: of two for one observation the longer rationale stays."""
    observed = _told(spark, sf_dir)[0]
    rules = curation.suggestions(observed).join(observed.select("observation_id", "type"), "observation_id").select("observation_id", "action", F.concat(F.lit("rule for "), F.col("type")).alias("rationale"))
    return decisions.merge_suggestions(rules, explain.proposals(observed).select("observation_id", "action", "rationale"))


_add("merged_proposals", _merged_proposals, f"SELECT observation_id, coalesce(s.action, p.action) AS action, CASE WHEN s.action IS NULL OR length(p.rationale) > length('rule for ' || type) THEN p.rationale ELSE 'rule for ' || type END AS rationale FROM (SELECT * FROM ({_SUGGEST}) WHERE action IS NOT NULL) s FULL JOIN ({_PROPOSED}) p USING (observation_id) JOIN (SELECT observation_id, type FROM ({_NUMBERED})) n USING (observation_id)")
_FACTORS = f"SELECT observation_id, confidence, 0.1 AS a, CASE WHEN type IN ('type_mismatch', 'constraint_violation') THEN 0.1 WHEN type = 'outlier' THEN -0.1 WHEN type = 'inconsistency' THEN 0 END AS b, CASE WHEN occurrences > 5 THEN 0.05 END AS c FROM ({_NUMBERED})"
_add("confidence_factors", lambda s, d: explain.factors(_told(s, d)[0], "clinical"), " UNION ALL ".join(f"SELECT observation_id, '{n}' AS factor, CAST({c} AS DOUBLE) AS impact FROM ({_FACTORS}) WHERE {c} IS NOT NULL" for n, c in (("domain", "a"), ("kind", "b"), ("evidence", "c"))))
_add("calibration_reasons", lambda s, d: explain.reasoned(_told(s, d)[0], "clinical").select("observation_id", "calibrated", "reasoning"), f"SELECT observation_id, k AS calibrated, 'Confidence ' || CASE WHEN moved >= 0 THEN 'raised' ELSE 'lowered' END || ' from ' || CAST(round(confidence * 100) AS INTEGER) || '% to ' || CAST(round(k * 100) AS INTEGER) || '% for clinical data.' AS reasoning FROM (SELECT observation_id, confidence, a + coalesce(b, 0) + coalesce(c, 0) AS moved, round(greatest(0, least(1, CAST(confidence + a + coalesce(b, 0) + coalesce(c, 0) AS DOUBLE))), 6) AS k FROM ({_FACTORS}))")
_add("column_insights", lambda s, d: explain.column_insights(_told(s, d)[1], "clinical").select("column", "insight"), f"SELECT v.\"column\", '''' || v.\"column\" || ''' looks like ' || {_ROLE.replace(chr(34) + 'column' + chr(34), 'v.' + chr(34) + 'column' + chr(34))} || ' in clinical data: ' || inferred_type || ' with ' || n || ' distinct values.' AS insight FROM ({ORACLE_SQL['type_vote']}) v JOIN ({_d(TEXT)} SELECT c, count(*) AS n FROM d WHERE NOT missing GROUP BY c) u ON u.c = v.\"column\"")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality report of the orders table with planted defects."""
    return QUERIES["quality_report"](spark, sf_dir)
