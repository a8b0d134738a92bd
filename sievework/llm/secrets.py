"""Secret scans with DataFrame functions alone.

Base rules find assignments, access keys and hexadecimal strings.  Two first-order Markov models of characters, one
of random strings and one of ordinary identifiers, then score every other long token by the ratio of its likelihoods.
The random model learns from the values that the base rules label and from hashes, the ordinary one from the words
of a bounded sample of texts.

Positions are code points, ends exclusive.  A match's place is the length of what stands before it: splitting a text
by a pattern gives the pieces between the matches.

Defined cases: null text is empty and has no spans; spans of different kinds may overlap, a Markov span overlaps no
base span; spans that tie in their start go by kind; equal rows give equal results; an empty table gives no rows; texts of
any length are scanned whole, at a cost that grows with the square of the matches of one text, as spans are appended one
by one; other columns are ignored, but `scan` replaces columns that are called as the kinds (`hide_secrets` keeps them).
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.shared import hash_sample

# The base rules; hexadecimal strings and tokens are runs of characters.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
SHORTEST = {"assign": 12, "access": 18, "hex": 16, "markov": 16}
KINDS = ["assign", "access", "hex", "markov"]
#: Characters that the Markov models tell apart: letters, and one each for digits and symbols.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0-"
SIZE = len(LETTERS)
#: Texts that the models learn from, in the order of a hash of doc_id and text; hashes added to the random strings.
SAMPLE_TEXTS, RANDOM_STRINGS = 2000, 2000
#: A token is reported if its log-likelihood ratio is above this, and above a share of it a character.
LEAST_RATIO, LEAST_PER_CHAR = 8.0, 0.35

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: Column, kind: str, pattern: str, quick: str, measured: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches whose group `measured` is long enough.  Only texts that match
    `quick` are looked through; it must match wherever there is such a span."""
    between = F.split(text, pattern, -1)
    whole, part = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, measured))
    matches = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("between"), whole.alias("whole"), part.alias("part"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["between"])
        end = start + F.length(m["whole"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(m["part"]) >= SHORTEST[kind], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.expr(f"cast(array() as {SPAN})")
    found = F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(quick), found).otherwise(none)


def _runs(text: Column, kind: str, letters: str) -> Column:
    """Spans of the maximal runs of some characters that are long enough: shorter runs need no match of their own."""
    pattern = letters + "{%d,}" % SHORTEST[kind]
    return _spans(text, kind, pattern, pattern)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with columns assign, access and hex of spans; `text` must not be null."""
    text = F.col("text")
    assign = _spans(text, "assign", ASSIGN, ASSIGN[:-2] + "{%d,})" % SHORTEST["assign"], 2)
    access = _spans(text, "access", ACCESS, ACCESS[:-1] + "{%d,}" % (SHORTEST["access"] - 4))
    return docs.withColumn("assign", assign).withColumn("access", access).withColumn("hex", _runs(text, "hex", "[0-9a-f]"))


def _codes(token: Column) -> Column:
    """The places in LETTERS (from 1) of a token's characters."""
    plain = F.translate(token, "0123456789+/_=.", "0000000000-----")
    return F.transform(F.split(plain, ""), lambda c: F.call_function("locate", c, F.lit(LETTERS)))


def _transitions(tokens: DataFrame, token: str) -> DataFrame:
    """a, b and how often b follows a."""
    pairs = tokens.select(_codes(F.col(token)).alias("c")).filter(F.size("c") > 1).select(F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).count()


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, random_strings: int = RANDOM_STRINGS) -> list[float]:
    """For each pair of characters the log of how much likelier the step is in a random string than in an identifier."""
    spark = docs.sparkSession
    sample = hash_sample(docs, sample_texts, docs.count(), "doc_id", "text")
    words = sample.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_]{4,}"), F.lit(0))).alias("token"))
    labelled = base_spans(sample).select("text", F.explode(F.concat("access", "hex", "assign")).alias("s")).select(F.expr("regexp_extract(substring(text, s.start + 1, s.end - s.start), '([A-Za-z0-9+/_-]+)$', 1)").alias("token"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(random_strings).select(F.explode(F.array(digest, F.base64(F.unhex(digest)), F.expr("upper(substring(translate(base64(unhex(sha2(string(id), 256))), '+/=', 'XYZ'), 1, 20))"))).alias("token"))
    tables = []
    for tokens in (labelled.unionByName(made), words):
        counts = {(r.a, r.b): r["count"] for r in _transitions(tokens, "token").collect()}  # at most SIZE * SIZE rows
        total = {a: sum(n for (x, _), n in counts.items() if x == a) for a in range(SIZE + 1)}
        tables.append({(a, b): log((counts.get((a, b), 0) + 0.5) / (total[a] + 0.5 * SIZE)) for a in range(1, SIZE + 1) for b in range(1, SIZE + 1)})
    return [tables[0][a, b] - tables[1][a, b] for a in range(1, SIZE + 1) for b in range(1, SIZE + 1)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token's steps from character to character."""
    table = F.array(*[F.lit(float(x)) for x in model])

    def step(acc: Column, c: Column) -> Column:
        gain = F.when(acc["last"] > 0, F.element_at(table, (acc["last"] - 1) * SIZE + c)).otherwise(F.lit(0.0))
        return F.struct(c.alias("last"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(_codes(token), F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def markov_spans(docs: DataFrame, model: list[float]) -> DataFrame:
    """docs (with the base spans) and column markov: likely random tokens that overlap no base span."""
    base = F.concat("assign", "access", "hex")

    def wanted(s: Column) -> Column:
        ratio = log_ratio(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]), model)
        free = ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
        return free & (ratio > LEAST_RATIO) & (ratio > LEAST_PER_CHAR * (s["end"] - s["start"]))

    return docs.withColumn("markov", _runs(F.col("text"), "markov", "[A-Za-z0-9+/_=-]")).withColumn("markov", F.filter("markov", wanted))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with columns assign, access, hex, markov of spans (start, rank, end, kind)."""
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    own = docs.withColumnRenamed(id_col, "doc_id").withColumn("text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return markov_spans(base_spans(own), model)


def joined(*columns: str) -> Column:
    """kind:start:end of all spans, by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.concat(*columns)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (also where spans overlap) replaced by one mark."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, kept).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(joined(*KINDS[:3]), 256).alias("base_sha256"), joined(*KINDS).alias("spans"))


def hide_secrets(docs: DataFrame) -> DataFrame:
    """docs (all columns, whatever their names) with every span of `text` replaced by a mark and n_chars counted anew.  Null
    text becomes empty; repeated rows stay and are treated alike; an empty table gives no rows."""
    own = ("text", "n_chars")
    others = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c not in own])
    found = scan(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), others.alias("__row")))
    done = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return found.withColumn("text", redact(F.col("text"), F.concat(*KINDS))).select(*[done.get(c, F.col(f"__row.`{c}`").alias(c)) for c in docs.columns])
