"""Every query of the data-quality engine gives the rows of its SQL."""

from __future__ import annotations

import pytest

from sievework import queries
from tests.oracle import connect, of_duckdb, of_spark


@pytest.fixture(scope="module")
def con(sf_dir):
    with connect(sf_dir) as c:
        yield c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, sf_dir, con, name):
    assert of_spark(queries.QUERIES[name](spark, sf_dir)) == of_duckdb(con, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
