"""A corpus pipeline: quality filter, near-duplicate removal, repeated-substring removal, secret removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
`run` writes each stage's result as Parquet to the shared folder and reads it as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import jaccard, packing, quality, secrets, suffixes
from sievework.llm.shared import staged


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, and all other columns in one, so that their names meet none of a stage's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    return docs.select("doc_id", "text", "n_chars", F.struct(F.lit(0).alias("__none"), *others).alias("__other"))


def _together(done: DataFrame, docs: DataFrame) -> DataFrame:
    return done.select(*[F.col(c) if c in ("doc_id", "text", "n_chars") else F.col(f"__other.`{c}`").alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays."""
    return jaccard.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters all of whose bytes lie in 50-byte repeats of earlier documents go; documents stay, if need be empty."""
    kept = suffixes.dedup_bytes(_apart(docs), carry=("__other",))
    return _together(kept.withColumn("n_chars", F.length("text").cast("long")), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _together(secrets.hide_secrets(_apart(docs)), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(staged(pieces, "pieces"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
