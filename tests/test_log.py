"""The log of decisions, and mappings of standardizations without parameters."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from sievework.operators.values import value_dictionary
from sievework.plans import apply, curation, decisions, fallback, log
from tests.test_plans import OBSERVED


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    one = lambda k: log.append(path, spark.createDataFrame([(k, "accepted"), (100, "accepted" if k % 2 else "rejected")], "observation_id long, status string"), f"w{k}", f"2024-01-01 00:00:{k:02}")
    with ThreadPoolExecutor(6) as pool:
        names = list(pool.map(one, range(12)))
    assert len(set(names)) == 12 and log.history(spark, path).count() == 24
    state = {r.observation_id: r.status for r in log.replay(spark, path)[0].collect()}
    assert state == dict.fromkeys(range(12), "accepted") | {100: "accepted"}
    assert {r.observation_id for r in log.replay(spark, path, "2024-01-01 00:00:03")[0].collect()} == {0, 1, 2, 3, 100}
    log.reset(path, spark, [3, 100], "w", "2024-01-02 00:00:00")
    assert {r.observation_id for r in log.replay(spark, path)[0].collect()} == set(range(12)) - {3}


def test_a_modified_mapping_changes_the_curated_table(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(1, "a"), (2, "A"), (3, "A")], "_row_id long, kind string")
    observed = spark.createDataFrame([(1, "inconsistency", "warning", "kind", "case_variant_validator", 0.9, 3, 60.0)], OBSERVED)
    suggested = curation.suggestions(observed)
    log.append(path, decisions.decide(suggested, None, decisions.ACCEPTED), "first", "2024-01-01 00:00:00")
    log.append(path, decisions.modify(suggested, None, 1), "second", "2024-01-01 00:00:01", spark.createDataFrame([(1, "a", "alpha"), (1, "A", "alpha")], "observation_id long, value string, new string"))
    for until, expected in (("2024-01-01 00:00:00", {"A"}), (None, {"alpha"})):
        decided, own = log.replay(spark, path, until)
        done = apply.apply_decided(rows, apply.resolved(decided, suggested, observed), apply.mappings(value_dictionary(rows, ["kind"])), {}, changes_of=own)
        assert {r.kind for r in done.rows.collect()} == expected


def test_fallback_sources(spark):
    values = value_dictionary(spark.createDataFrame([(1, "b "), (2, "B"), (3, "c"), (4, "NA")], "_row_id long, x string"), ["x"])
    asked = spark.createDataFrame([
        (1, "inconsistency", "x", "Case variants", '{"k":{"K":2,"k":2,"kk":1}}'), (2, "inconsistency", "x", "Case variants", None), (3, "inconsistency", "x", "Possible typos: 'abd' → 'abc', 'q' → '', 'abd' → 'abe'", None),
        (4, "inconsistency", "x", "Mixed date formats 'a' → 'b'", None), (5, "outlier", "x", "typo 'a' → 'b'", None), (6, "inconsistency", "x", "a typo", "{}"),
    ], "observation_id long, type string, column string, description string, counts string").withColumn("value_counts", F.parse_json("counts")).drop("counts")
    found = sorted(tuple(r) for r in fallback.fallback_mapping(asked, values).collect())
    assert found == [(1, "k", "K", "evidence"), (1, "kk", "K", "evidence"), (2, "b", "B", "data"), (3, "abd", "abe", "text"), (3, "q", "", "text")]
    assert fallback.fallback_mapping(asked.limit(0), values).isEmpty()
