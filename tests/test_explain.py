"""Texts about columns and observations: all kinds, evidence, clashing and missing parts, empty tables."""

from __future__ import annotations

import json

from sievework.plans import decisions, explain

OBSERVED = "observation_id long, type string, severity string, column string, detector string, confidence double, occurrences long, percentage double, sample_rows array<long>"
PROFILE = "column string, count long, null_count long, unique_count long, is_unique boolean, inferred_type string, low double, high double, semantic_role string"
ROWS = [
    (1, "outlier", "warning", "price", "statistical_outlier_validator", 0.85, 3, 1.5, [4, 9]),
    (2, "outlier", "warning", "gone", "statistical_outlier_validator", 0.05, 30, None, None),
    (3, "inconsistency", "info", "status=mixed", "typo_validator", 0.75, 6, 2.0, [1]),
    (4, "inconsistency", "info", "status", "new_check", 0.98, 1, 2.0, []),
    (5, "completeness", "error", "price", "completeness_validator", 0.95, 500, 33.26, None),
    (6, "duplicate", "error", "id", "uniqueness_validator", 0.95, None, None, None),
    (7, "never_seen", "info", "odd 'name' {type}", "x", 0.5, 1, 1.0, None),
]


def observed(spark, rows=ROWS):
    return spark.createDataFrame(rows, OBSERVED)


def profiled(spark):
    return spark.createDataFrame([("price", 10, 1, 9, True, "float", 1.0, 2.0, "covariate"), ("status", 10, 0, 2, False, "string", None, None, "grouping"), ("id", 10, 0, 10, True, None, None, None, "identifier")], PROFILE)


def test_explanations(spark):
    found = {r.observation_id: r.explanation for r in explain.explained(observed(spark), profiled(spark), "soil studies").collect()}
    assert len(found) == len(ROWS) and all(found.values())
    assert "'price' (float)" in found[1] and "'gone' (unknown)" in found[2] and "'status' (string)" in found[3]
    assert "'odd 'name' {type}'" in found[7] and "never_seen" in found[7]


def test_proposals(spark):
    found = {r.observation_id: r for r in explain.proposals(observed(spark)).collect()}
    assert {k: (r.action, r.priority, r.confidence) for k, r in found.items()} == {
        1: ("flag", 4, 0.7), 2: ("flag", 4, 0.7), 3: ("standardize", 3, 0.85), 4: ("standardize", 3, 0.85), 5: ("flag", 3, 0.7), 6: ("flag", 2, 0.8)}
    assert found[1].rationale.endswith("First rows: 4, 9.") and "First rows" not in found[2].rationale
    assert "typos of 'status'" in found[3].rationale and "in one way" in found[4].rationale
    assert found[5].rationale.endswith("Percent missing: 33.3.")


def test_factors_add_up_to_the_calibrated_confidence(spark):
    for domain in ("clinical", "environmental", "finance"):
        sums = {r.observation_id: r.s for r in explain.factors(observed(spark), domain).groupBy("observation_id").agg({"impact": "sum"}).withColumnRenamed("sum(impact)", "s").collect()}
        found = {r.observation_id: r for r in explain.reasoned(observed(spark), domain).collect()}
        assert set(found) == set(sums) == {r[0] for r in ROWS}
        for k, r in found.items():
            assert abs(r.calibrated - min(1, max(0, r.confidence + sums[k]))) < 1e-6
            assert ("raised" in r.reasoning) == (round(sums[k], 6) >= 0) and domain in r.reasoning
    assert explain.reasoned(observed(spark), "finance").filter("observation_id = 2").first().calibrated == 0.0


def test_answers_and_requests(spark):
    answers = {r.observation_id: r.answer for r in explain.answers(observed(spark), "soil").collect()}
    assert "3 cells of kind outlier in 'price'" in answers[1] and "85% sure" in answers[1] and "some cells" in answers[6] and answers[7]
    samples = spark.createDataFrame([("price", ["1", '2"x'])], "column string, sample_values array<string>")
    asked = {r.column: json.loads(r.request.partition("\n")[2]) for r in explain.column_requests(profiled(spark), samples, "soil").collect()}
    assert asked["price"]["sample_values"] == ["1", '2"x'] and asked["status"]["sample_values"] == [] and asked["id"]["domain"] == "soil"
    about = {r.observation_id: json.loads(r.request.partition("\n")[2]) for r in explain.observation_requests(observed(spark), profiled(spark)).collect()}
    assert about[1]["sample_rows"] == [4, 9] and about[3]["semantic_role"] == "grouping" and "inferred_type" not in about[2]


def test_empty_tables(spark):
    none, known = observed(spark, []), profiled(spark).limit(0)
    for df in (explain.explained(none, known), explain.proposals(none), explain.factors(none), explain.reasoned(none), explain.answers(none), explain.column_insights(known), explain.observation_requests(none, known)):
        assert df.count() == 0


def test_proposals_meet_rules(spark):
    rules = spark.createDataFrame([(1, "flag", "short"), (8, "remove", "a rule of its own")], "observation_id long, action string, rationale string")
    found = {r.observation_id: r for r in decisions.merge_suggestions(rules, explain.proposals(observed(spark)).select("observation_id", "action", "rationale")).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, 8} and found[8].rationale == "a rule of its own" and "far values" in found[1].rationale
