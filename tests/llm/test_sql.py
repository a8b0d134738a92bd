"""Numbered operators give the rows of their SQL, over whole tables."""

from __future__ import annotations

import pytest

from sievework.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    with connect(sf_dir) as con:
        columns = [c[0] for c in con.execute(ORACLE_SQL[name]).description]
        assert set(found.columns) == set(columns)
        assert of_spark(found.select(*columns)) == of_duckdb(con, ORACLE_SQL[name])
