"""Divergence of sources against a plain sum over all terms."""

from __future__ import annotations

import os
import random

import pyarrow.parquet as pq
import pytest

from sievework.llm import divergence
from tests.llm import brute

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def odd_documents() -> list[tuple]:
    r = random.Random(8)
    words = ["the", "The", "de", "été", "ÉTÉ", "ß", "日本", "a1b", "x_y", " ", "KK", "don't", "\u0085", "q", "Zebra"]
    some = lambda: " ".join(r.choices(words, k=r.randint(0, 12)))
    docs = [(r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "S1", "é", None]), some()) for _ in range(160)]
    docs += [("one", "only", "word word"), *[("one", "only", "word other")] * 11, ("none", "a", "rare"), ("none", "b", None), ("none", "b", ""), (None, None, None)]
    docs += [("en", f"t{k % 3}", "same text in three sources") for k in range(30)] + [("en", "long", "wörd " * 30_000 + "z" * 5000)] + [("en", "empty", "")]
    return docs


def check(spark, docs) -> None:
    df = spark.createDataFrame([(k, *d, 1, "n", "t") for k, d in enumerate(docs)], "doc_id long, lang string, source string, text string, n int, term string, item string").repartition(3)
    found = sorted((tuple(r) for r in divergence.divergence(df).select(COLUMNS).collect()), key=repr)
    assert found == sorted(brute.op11(docs), key=repr)


@pytest.mark.parametrize("bounds", [(1 << 20, 200_000, 1 << 20), (1000, 3, 10)])
def test_odd_rows(spark, monkeypatch, bounds):
    for name, value in zip(("PIECE", "HELD", "CELLS"), bounds, strict=True):
        monkeypatch.setattr(divergence, name, value)
    check(spark, odd_documents())


def test_empty_table(spark):
    check(spark, [])


def test_small_table(spark, sf_dir):
    table = pq.read_table(os.path.join(sf_dir, "documents.parquet"), columns=["lang", "source", "text"])
    check(spark, list(zip(*(c.to_pylist() for c in table.columns), strict=True)))


@pytest.mark.parametrize("piece", [1, 7, 5000])
def test_terms_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(divergence, "PIECE", piece)
    text = ("Ab c " + "x" * 9000 + " ÉÀ " + "y" * 4096 + "1" + "z" * 4097).encode()
    assert [t for p in divergence.terms_of(text) for t in p] == text.translate(divergence._TERM).split()
