"""Pairs of texts within two edits, by an index of deletions.

Texts within two edits have a text in common that each becomes when up to two of its characters go.  Both sides list the
hashes of these texts and meet on them; the distance then decides.  A text of n characters has about n * n / 2 of them, so
a text of more than LONG characters is cut in halves instead: of two edits one half sees one at most, so that half and a
start (or end) of the other text have a text in common after one deletion each; that is about n hashes on one side and 5 n
on the other.  The rows that meet follow the number of texts and of those that are near each other, not all texts of like
length.  Long texts that share a whole half, a fixed beginning for example, do meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that is indexed whole.
LONG = 40
EDITS = 2


def _without_two(text: Column) -> Column:
    """Hashes of a text and of what it becomes without one or two of its characters."""
    n = F.length(text)
    before, after = (lambda i: F.substring(text, F.lit(1), i - 1)), (lambda i: F.substring(text, i + 1, n))
    one = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(before(i), after(i)))))
    pair = lambda i, j: F.xxhash64(F.concat(before(i), F.substring(text, i + 1, j - i - 1), after(j)))
    two = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: pair(i, j)))))
    none = F.expr("cast(array() as array<bigint>)")
    return F.concat(F.array(F.xxhash64(text)), F.coalesce(one, none), F.coalesce(two, none))


def _without_one(text: Column, side: str) -> Column:
    """Hashes of a part of a text and of what it becomes without one character, apart for starts and ends of texts."""
    n = F.length(text)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.lit(side), F.when(i == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))))


def _start(text: Column, size: Column) -> Column:
    return F.substring(text, F.lit(1), size)


def _end(text: Column, size: Column) -> Column:
    return F.substring(text, F.length(text) - size + 1, size)


def _index(text: Column) -> Column:
    n = F.length(text)
    first = F.floor(n / 2).cast("int")
    halves = F.concat(_without_one(_start(text, first), "start"), _without_one(_end(text, n - first), "end"))
    return F.array_distinct(F.when(n <= LONG, _without_two(text)).otherwise(halves))


def _probes(text: Column) -> Column:
    n = F.length(text)
    none = F.expr("cast(array() as array<bigint>)")
    whole = F.when(n - EDITS <= LONG, _without_two(text)).otherwise(none)
    # Halves of texts of n - 2 to n + 2 characters, each one character shorter or longer.
    sizes = lambda low, high: F.sequence(F.floor(low / 2).cast("int") - 1, F.floor(high / 2).cast("int") + 1)
    starts = F.flatten(F.transform(sizes(n - EDITS, n + EDITS), lambda k: _without_one(_start(text, k), "start")))
    ends = F.flatten(F.transform(sizes(n - EDITS + 1, n + EDITS + 1), lambda k: _without_one(_end(text, k), "end")))
    return F.array_distinct(F.concat(whole, F.when(n + EDITS > LONG, F.concat(starts, ends)).otherwise(none)))


def close_pairs(texts: DataFrame, others: DataFrame, text: str = "text", other: str = "other") -> DataFrame:
    """Columns of both sides and edits, for each text and other of one `column` within two edits (0: equal).  A pair comes as
    often as it meets; what is wanted of it is best aggregated."""
    left = texts.withColumn("__key", F.explode(_probes(F.col(text))))
    right = others.withColumn("__key", F.explode(_index(F.col(other))))
    edits = F.levenshtein(F.col(text), F.col(other), EDITS)
    return left.join(right, ["column", "__key"]).drop("__key").withColumn("edits", edits).filter("edits >= 0")
