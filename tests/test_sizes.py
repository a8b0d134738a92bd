"""Tasks of an analysis do not grow with its rows, and what is asked of it later does not read the rows again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievework.plans import evidence, fallback
from sievework.plans.analyze import analyze
from sievework.sources import shared


def _orders(spark, n=600):
    status = F.when(F.col("id") % 7 == 0, "open").when(F.col("id") % 3 == 0, "OPEN").when(F.col("id") % 5 == 0, "missing").otherwise("closed")
    return spark.range(n).select(F.col("id").alias("order_id"), status.alias("status"), F.concat(F.lit("https://x.org/"), F.col("id") % 500).alias("url"), (F.col("id") % 90).cast("string").alias("price"))


def _rows(df):
    return sorted(map(str, df.collect()))


def test_values_of_an_analysis_are_kept(spark):
    """The dictionary is read where it was written: its plan groups nothing."""
    plan = analyze(_orders(spark), "order_id").values._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Relation" in plan


def test_tasks_follow_a_bound(spark, monkeypatch):
    """With a bound of 40 rows a task, 600 rows make 15 tasks of a grouping at least, and the same results."""
    whole = analyze(_orders(spark), "order_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(shared, "TASK_ROWS", 40)
    cut = analyze(_orders(spark), "order_id")
    assert _rows(cut.observations) == _rows(whole.observations) and _rows(cut.values) == _rows(whole.values)
    with shared.sized(spark, 600):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "15"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    with pytest.raises(ValueError), shared.sized(spark, 10**6):
        raise ValueError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_few_and_many_groups_mark_the_same_rows(spark, monkeypatch):
    """Groups that are broadcast and groups that are joined by parts."""
    found = analyze(_orders(spark), "order_id")
    few = _rows(evidence.about(found, found.observations))
    assert few
    monkeypatch.setattr(evidence, "FEW_BYTES", -1)
    assert _rows(evidence.about(found, found.observations)) == few


def test_first_rows_are_those_of_all(spark):
    found = analyze(_orders(spark), "order_id")
    by = {}
    for r in evidence.about(found, found.observations).collect():
        by.setdefault(r.observation_id, []).append(r._row_id)
    assert {r.observation_id: r.sample_rows for r in evidence.evidence(found).collect() if r.sample_rows} == {k: sorted(v)[: evidence.FIRST] for k, v in by.items()}


def test_sources_of_a_mapping_read_observations_once(spark):
    """Whatever made the observations is made once, not once for each source."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def told(k):
        made.add(1)
        return k

    values = spark.createDataFrame([("a", "x", 2, 1, False), ("a", "X", 1, 2, False), ("b", "y", 1, 1, False)], "column string, value string, n long, first_row long, missing boolean")
    seen = spark.createDataFrame([(1, "inconsistency", "a", "Case variants")], "k long, type string, column string, description string")
    observations = seen.select(told.asNondeterministic()("k").alias("observation_id"), "type", "column", "description", F.lit(None).cast("variant").alias("value_counts"))
    assert [tuple(r) for r in fallback.fallback_mapping(observations, values).collect()] == [(1, "X", "x", "data")]
    assert made.value == 1
