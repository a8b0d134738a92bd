"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import quality, secrets
from tests.llm import brute


def test_pipeline(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = quality.quality_scores(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").select("doc_id").collect()
    good = {r.doc_id for r in scores}
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if r.doc_id in good]
    least = {d for d, _, c in brute.op3(docs) if d == c}
    docs = [(d, t) for d, t in docs if d in least]
    docs = list(brute.op1_texts(docs).items())
    found = secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text", F.concat(*secrets.KINDS).alias("spans")).collect()
    plain = []
    for r in found:
        text, marked = r.text, [False] * len(r.text)
        for s in r.spans:
            marked[s.start : s.end] = [True] * (s.end - s.start)
        starts = {s.start for s in r.spans if s.start == 0 or not any(o.start < s.start < o.end for o in r.spans)}
        plain.append((r.doc_id, "".join("[SECRET]" * (k in starts) + ("" if m else c) for k, (c, m) in enumerate(zip(text, marked, strict=True)))))
    out = corpus_pipeline.run(spark, sf_dir).collect()
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[n] for n in names) for r in out) == sorted(brute.op10_pieces(plain, public_tokenizers.path("word_bpe_49k.json")))
    brute.sound_packing([(r.sequence_id, r.offset, r.length) for r in out])


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    for docs_in in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs_in, sf_dir).columns == docs.columns


def test_stages_keep_extra_and_clashing_columns(spark):
    passage = "a passage that two of the documents have in common, longer than fifty bytes"
    rows = [(1, passage + " one", "en", "web", 1, "x", 7), (2, passage + " token: abcDEF123456xyz", "en", "web", 2, "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, assign string, extra int")
    for stage in (corpus_pipeline.suffix_dedup, corpus_pipeline.secret_scans):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert sorted((r.doc_id, r.lang, r.source, r.assign, r.extra) for r in out.collect()) == [(1, "en", "web", "x", 7), (2, "en", "web", "y", 8)]
