"""Columns of a user that are called as those an operator makes stay as they are."""

from __future__ import annotations

from sievework.llm import secrets


def test_hidden_secrets_keep_all_columns(spark):
    rows = [(1, "password = abcDEF123456xyz", 5, "a", "h", 7, "m", "x"), (2, None, None, None, "h", 8, "m", "y"), (2, None, None, None, "h", 8, "m", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, assign string, hex string, access int, markov string, `odd.name` string")
    found = secrets.hide_secrets(df)
    assert found.columns == df.columns
    assert sorted(tuple(r) for r in found.collect()) == [(1, "[SECRET]", 8, "a", "h", 7, "m", "x"), (2, "", 0, None, "h", 8, "m", "y"), (2, "", 0, None, "h", 8, "m", "y")]
    assert secrets.hide_secrets(df.limit(0)).count() == 0
