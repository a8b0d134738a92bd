"""Lexical primitives on text columns: trimming, missing tokens, guarded parsing, type detection, date formats.

Patterns use ASCII digits and end with \\z, since Java's $ also matches before a final line feed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a missing value.
MISSING = ["na", "n/a", "null", "none", "nil", ".", "-"]
MISSING_PATTERNS = ["missing", "unknown", "not available", "not recorded", "n.a.", "n.a", "na.", "#n/a", "#null", "undefined", "-999", "-9999", "999", "9999"]
BOOLEAN_TYPE_WORDS = ["true", "false", "yes", "no"]
BOOLEAN_WORDS = ["true", "false", "yes", "no", "t", "f", "y", "n", "1", "0"]
INTEGER = r"^[+-]?[0-9]+\z"
NUMBER = r"^[+-]?(?i:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"
DATE_START = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}|^[0-9]{4}/[0-9]{2}/[0-9]{2}"
MONTH = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def is_missing(c: Column) -> Column:
    t = F.lower(trim(c))
    return c.isNull() | (t == "") | t.isin(MISSING)


def as_integer(c: Column) -> Column:
    """A 64-bit integer, or null."""
    return F.when(c.rlike(INTEGER), c.try_cast("bigint"))


def as_number(c: Column) -> Column:
    """A double, or null; suffixes, hexadecimal and spaces are no numbers."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def value_type(c: Column) -> Column:
    """boolean, integer, float, datetime, date or string."""
    return (
        F.when(F.lower(c).isin(BOOLEAN_TYPE_WORDS), "boolean")
        .when(as_integer(c).isNotNull(), "integer")
        .when(as_number(c).isNotNull(), "float")
        .when(c.rlike(DATE_START), F.when(c.contains(":") | c.contains("T"), "datetime").otherwise("date"))
        .otherwise("string")
    )


def parses_as(c: Column, kind: Column) -> Column:
    """Whether a trimmed value is of a kind; kinds other than integer, float and boolean take anything."""
    t = trim(c)
    return F.when(kind == "integer", as_integer(t).isNotNull()).when(kind == "float", as_number(t).isNotNull()).when(kind == "boolean", F.lower(t).isin(BOOLEAN_WORDS)).otherwise(True)


def date_format(c: Column) -> Column:
    """Which of five ways a date is written in, or null."""
    return (
        F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "iso")
        .when(c.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}\z"), "ymd_slash")
        .when(c.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"), "mdy_slash")
        .when(c.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\z"), "mdy_dash")
        .when(c.rlike(MONTH), "month_name")
    )


def iso_date(c: Column) -> Column:
    """yyyy-mm-dd of a date in any of the five ways; what has no valid month and day stays as it is."""

    def built(pattern: str, year: int, month: int, day: int) -> Column:
        y, m, d = (F.regexp_extract(c, pattern, g) for g in (year, month, day))
        good = c.rlike(pattern) & m.cast("int").between(1, 12) & d.cast("int").between(1, 31)
        return F.when(c.rlike(pattern), F.when(good, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))))

    named = r"^([A-Za-z]{3})[a-z]* ([0-9]{1,2}),? ([0-9]{4})\z"
    month = F.call_function("locate", F.lower(F.regexp_extract(c, named, 1)), F.lit("jan feb mar apr may jun jul aug sep oct nov dec"))
    by_name = F.when(c.rlike(named) & (month > 0), F.concat_ws("-", F.regexp_extract(c, named, 3), F.lpad(((month + 3) / 4).cast("int").cast("string"), 2, "0"), F.lpad(F.regexp_extract(c, named, 2), 2, "0")))
    return F.coalesce(
        built(r"^([0-9]{4})-([0-9]{2})-([0-9]{2})\z", 1, 2, 3),
        built(r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})\z", 1, 2, 3),
        by_name,
        built(r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\z", 3, 1, 2),
        built(r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})\z", 3, 1, 2),
        c,
    )


def shape(c: Column) -> Column:
    """Digits as #, capitals as A, small letters as a."""
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return F.translate(c, digits + small.upper() + small, "#" * 10 + "A" * 26 + "a" * 26)


def title_case(c: Column) -> Column:
    """A small ASCII first letter made a capital."""
    return F.when(c.rlike("^[a-z]"), F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))).otherwise(c)


def any_contains(name: str, parts: list[str]) -> bool:
    return any(p in name.lower() for p in parts)


def one_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)
