"""Delimited files: delimiter sniffing, raw-text reading with row ids, content hash, plain writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import as_integer, as_number, is_missing

DELIMITERS = ["\t", ",", ";", "|"]
NAMES = {"\t": "tsv", ",": "csv", ";": "csv-semicolon", "|": "psv"}


def sniff(spark: SparkSession, path: str, lines: int = 10) -> str:
    """The delimiter that occurs most evenly in the first lines, outside of quotes; a comma where none does."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect() if r.value.strip()]
    if not head:
        raise ValueError(f"{path}: empty")
    best, chosen = 0.0, ","
    for d in DELIMITERS:
        counts = ["".join(line.split('"')[::2]).count(d) for line in head]
        mean = sum(counts) / len(counts)
        if len(set(counts)) == 1:
            score = counts[0] * 1000 + (100 if d == "\t" and counts[0] else 0)
        else:
            score = counts[0] * (100 if sum((c - mean) ** 2 for c in counts) / len(counts) < 1 else 1)
        if score > best:
            best, chosen = score, d
    return chosen


def numbered(rows: DataFrame) -> DataFrame:
    """rows with _row_id from 0 on, in their order: each partition goes on from the rows of those before it."""
    tagged = rows.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = {r.p: r.n for r in tagged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, starts = 0, {}
    for p in sorted(counts):
        starts[p], before = before, before + counts[p]
    first = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[part] if starts else F.lit(0)
    return tagged.select((F.col("_at").bitwiseAND((1 << 33) - 1) + first).alias("_row_id"), *[F.col(f"`{c}`") for c in rows.columns])


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, max_rows: int | None = None, line_feeds: bool = True) -> DataFrame:
    """All cells as text (short rows filled with empty ones, long ones cut) and _row_id from 0 in file order; of these
    rows the first max_rows.  A file without lines, columns or rows is an error.  Without line feeds inside cells (line_feeds false) Spark splits large files."""
    d = delimiter or sniff(spark, path)
    raw = spark.read.option("sep", d).option("header", header).option("multiLine", line_feeds).option("quote", '"').option("escape", '"').csv(path)
    if not raw.columns or raw.isEmpty():
        raise ValueError(f"{path}: no {'rows' if raw.columns else 'columns'}")
    if not header:
        raw = raw.toDF(*[f"column_{k + 1}" for k in range(len(raw.columns))])
    rows = numbered(raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns]))
    return rows if max_rows is None else rows.filter(F.col("_row_id") < max_rows)


def metadata(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """path, hash, size and format of a file."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"), F.col("length").alias("size"), F.lit(NAMES.get(delimiter, "delimited")).alias("format"))


def write_delimited(rows: DataFrame, path: str, delimiter: str = "\t") -> None:
    rows.drop("_row_id").write.option("sep", delimiter).option("header", True).option("emptyValue", "").csv(path)


def write_parquet(rows: DataFrame, path: str) -> None:
    """Text columns, empty cells as null."""
    rows.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns if c != "_row_id"]).write.parquet(path)


def typed_json(columns: list[str]) -> Column:
    """A row as one JSON object: missing cells as null, whole numbers, numbers and booleans as such, other cells as text."""

    def cell(name: str) -> Column:
        v = F.col(f"`{name}`")
        word = F.lower(v)
        quoted = F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}\z", 1)
        number = as_number(v)
        plain = F.when(as_integer(v).isNotNull(), as_integer(v).cast("string")).when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), number.cast("string"))
        return F.when(is_missing(v), "null").otherwise(F.coalesce(plain, F.when(word.isin("true", "false"), word), quoted))

    key = [F.lit(json.dumps(c, ensure_ascii=False) + ":") for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(k, cell(c)) for k, c in zip(key, columns, strict=True)]), F.lit("}"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(typed_json([c for c in rows.columns if c != "_row_id"]).alias("value")).write.text(path)


def resolve(stored: str, beside: str) -> str:
    """Where a source lies: at the stored path, or beside another file under its name or stem (tsv, csv, txt)."""
    from pathlib import Path

    first = Path(stored)
    near = Path(beside).parent / first.name
    for path in (first, near, *[near.with_suffix(f".{end}") for end in ("tsv", "csv", "txt")]):
        if path.exists():
            return str(path)
    raise FileNotFoundError(stored)
