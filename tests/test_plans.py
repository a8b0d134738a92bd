"""Sources, decisions and saved curations."""

from __future__ import annotations

import importlib
import importlib.util
import sys

import pytest
from pyspark.sql import functions as F

from sievework.operators import inference, profile, samples
from sievework.operators.values import value_dictionary
from sievework.plans import apply, checks, curation, decisions, evidence
from sievework.plans.analyze import analyze, quality_report
from sievework.sources import delimited, ontology


def test_delimited_round_trip(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("x\ty\n1\t2\n3\n4\t5\t6\n\"a\tb\"\t\n")
    assert delimited.sniff(spark, str(path)) == "\t"
    rows = delimited.read_delimited(spark, str(path))
    assert [(r.x, r.y) for r in rows.orderBy("_row_id").collect()] == [("1", "2"), ("3", ""), ("4", "5"), ("a\tb", "")]
    delimited.write_delimited(rows, str(tmp_path / "out"))
    again = delimited.read_delimited(spark, str(tmp_path / "out"), "\t")
    assert sorted((r.x, r.y) for r in again.collect()) == sorted((r.x, r.y) for r in rows.collect())


def test_obo(spark, tmp_path):
    path = tmp_path / "a.obo"
    path.write_text('format-version: 1.2\n\n[Term]\nid: X:1\nname: Forest\ndef: "Trees." []\nsynonym: "woods" EXACT []\nis_a: X:0 ! biome\n\n[Typedef]\nid: part_of\n\n[Term]\nid: X:2\nname: Lake\n')
    terms = ontology.read_obo(spark, str(path))
    assert sorted((r.id, r.label, r.definition, list(r.synonyms), list(r.parents)) for r in terms.collect()) == [("X:1", "Forest", "Trees.", ["woods"], ["X:0"]), ("X:2", "Lake", None, [], [])]
    found = ontology.lookup(spark.createDataFrame([("forest",), ("Woods",), ("sea",)], "value string"), terms)
    assert sorted(tuple(r) for r in found.collect()) == [("Woods", "X:1", 0.95), ("forest", "X:1", 1.0)]


def test_saved_curation(spark, tmp_path):
    observed = spark.createDataFrame([(1, "outlier"), (2, "duplicate")], "observation_id long, type string")
    suggested = spark.createDataFrame([(1, "a", "flag"), (2, "b", "flag")], "observation_id long, column string, action string")
    decided = decisions.decide(suggested, None, decisions.ACCEPTED, column="A")
    path = str(tmp_path / "c" / "curation.json")
    decisions.save(path, observed, suggested, decided, "2024-01-01T00:00:00")
    decided = decisions.decide(suggested, decided, decisions.REJECTED)
    decisions.save(path, observed, suggested, decided, "2024-01-02T00:00:00")
    assert [p.name for p in decisions.history(path)] == ["2024-01-01T00-00-00.json"]
    assert sorted(tuple(r) for r in decisions.load(spark, path)["decisions"].collect()) == [(1, "accepted"), (2, "rejected")]
    assert decisions.reset(decided, [1]).count() == 1


def test_merge_suggestions(spark):
    kind = "observation_id long, action string, rationale string"
    a, b = spark.createDataFrame([(1, "x", "long text"), (2, "x", "t")], kind), spark.createDataFrame([(2, "y", "longer"), (3, "y", "z")], kind)
    assert sorted(tuple(r) for r in decisions.merge_suggestions(a, b).collect()) == [(1, "x", "long text"), (2, "x", "longer"), (3, "y", "z")]


def test_entry_without_corpus_operators(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("sievework.llm", "corpus_pipeline")) else found(name, *a))
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(sys.modules["sievework.queries"].QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_a_library(monkeypatch):
    """Where a module of the corpus operators can't be imported, the engine's queries stay."""
    own = importlib.import_module

    def lost(name, *a):
        if name.startswith(("sievework.llm", "corpus_pipeline")):
            raise ImportError(name)
        return own(name, *a)

    entry = own("__spark_entry__")
    monkeypatch.setattr(importlib, "import_module", lost)
    assert set(entry.queries()) == set(sys.modules["sievework.queries"].QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_report_runs_every_check(spark):
    rows = []
    for i in range(12):
        r = {"visit": i, "sample_id": f"S{min(i, 10):03}", "start_date": "2024-01-01", "end_date": "2024-06-01", "dose": str(10 + i), "site": "north" if i % 2 else "south", "latitude": "45.5", "consent": ("yes", "no", "TRUE")[i % 3], "sex": "M" if i == 2 else "F", "pregnant": "yes" if i == 2 else "no", "weight": "80", "height": "2", "bmi": "20"}
        changed = {1: {"start_date": "05/06/2024"}, 2: {"start_date": "2025-01-01", "bmi": "30"}, 3: {"dose": "500"}, 4: {"dose": " 900"}, 6: {"site": " west"}, 7: {"site": " NORTH"}, 8: {"latitude": "95.5"}}
        rows.append(r | changed.get(i, {}))
    rows[9] = rows[0] | {"visit": 9, "sample_id": "S009"}
    names = list(rows[0])
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {'long' if n == 'visit' else 'string'}" for n in names))
    new = ("range_validator", "set_validator", "statistical_outlier_validator", "consistency_validator", "date_format_validator", "cross_column_validator", "coordinate_validator", "duplicate_row_validator")
    found = {(r.detector, r.severity, r["column"], r.occurrences) for r in quality_report(df, "visit").collect() if r.detector in new}
    assert found == {
        ("range_validator", "info", "dose", 1), ("set_validator", "warning", "site", 2),
        ("statistical_outlier_validator", "warning", "dose", 2), ("statistical_outlier_validator", "info", "latitude", 1), ("statistical_outlier_validator", "info", "bmi", 1),
        ("consistency_validator", "warning", "site", 1), ("consistency_validator", "warning", "consent", 3), ("date_format_validator", "warning", "start_date", 12),
        ("cross_column_validator", "warning", "start_date vs end_date", 1), ("cross_column_validator", "warning", "bmi", 1), ("cross_column_validator", "error", "sex vs pregnant", 1),
        ("coordinate_validator", "error", "latitude", 1), ("duplicate_row_validator", "warning", "_table", 1), ("duplicate_row_validator", "error", "sample_id", 1),
    }


def test_readiness_of_organisms_and_nulls(spark):
    names = ["Homo sapiens", "homo sapiens", "E. coli", "Mus muscullus", "unknown", "n/a", "Some thing", "Bogus", "not collected", ""]
    rows = [(k, f"s{k}", o, "2020", "1 2", "N/A" if k == 1 else "missing") for k, o in enumerate(names)]
    df = spark.createDataFrame(rows, "_row_id long, sample string, organism string, date string, place string, note string")
    # bad organisms: homo sapiens, E. coli, Mus muscullus, unknown, n/a, Bogus; bad nulls: unknown, n/a, N/A
    found = samples.submission_readiness(df, ["sample"], "date", "place", "organism").first()
    assert (found.samples, found.n_duplicate, found.n_bad_organism, found.n_bad_null, found.n_mismatch, found.score, found.is_ready) == (10, 0, 6, 3, 0, 83, False)
    # E. coli, Mus muscullus, unknown, Some thing and Bogus name no human or microbe of humans: 100 - (5 * 25 + 2 * 5) / 9 - 5
    found = samples.submission_readiness(df.filter("_row_id <> 5"), ["sample"], "date", "place", "organism", True).first()
    assert (found.samples, found.n_bad_organism, found.n_bad_null, found.n_mismatch, found.score, found.is_ready) == (9, 5, 2, 5, 80, False)
    clean = samples.submission_readiness(df.filter("_row_id = 0"), ["sample"], "date", "place", "organism").first()
    assert (clean.score, clean.is_ready) == (100, True)
    assert samples.submission_readiness(df.limit(0), ["sample"], "date", "place", "organism").first().score == 0


def test_source_beside_another_file(tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert delimited.resolve("/nowhere/a.tsv", str(tmp_path / "curation.json")) == str(tmp_path / "a.csv")
    with pytest.raises(FileNotFoundError):
        delimited.resolve("/nowhere/b.tsv", str(tmp_path / "curation.json"))


def test_single_decisions(spark):
    suggested = spark.createDataFrame([(1, "a", "flag"), (2, "b", "flag")], "observation_id long, column string, action string")
    one = decisions.decide_one(suggested, None, 1, decisions.ACCEPTED)
    both = decisions.decide_one(suggested, one, 2, decisions.REJECTED)
    assert sorted(tuple(r) for r in both.collect()) == [(1, "accepted"), (2, "rejected")]
    with pytest.raises(ValueError):
        decisions.decide_one(suggested, both, 1, decisions.REJECTED)
    with pytest.raises(KeyError):
        decisions.decide_one(suggested, both, 9, decisions.REJECTED)


OBSERVED = "observation_id long, type string, severity string, column string, detector string, confidence double, occurrences long, percentage double"


def test_apply_decided(spark):
    rows = spark.createDataFrame([(1, "a", "-5", "x"), (2, "A", "7", ""), (3, "A", "n/a", "y"), (4, "gone", "z", "y"), (5, "gone", "8", "y")], "_row_id long, kind string, price string, `odd name` string")
    observed = spark.createDataFrame(
        [(1, "outlier", "error", "price", "statistical_outlier_validator", 0.95, 1, 20.0), (2, "inconsistency", "warning", "kind", "case_variant_validator", 0.9, 3, 60.0), (3, "missing_pattern", "warning", "kind=gone", "missing_pattern_validator", 0.88, 2, 40.0), (4, "type_mismatch", "warning", "price", "type_validator", 0.9, 1, 5.0), (5, "duplicate", "error", "_table", "duplicate_row_validator", 0.98, 1, 20.0), (6, "completeness", "error", "odd name", "completeness_validator", 0.95, 1, 20.0)], OBSERVED)
    suggested = curation.suggestions(observed)
    decided = decisions.decide(suggested, None, decisions.ACCEPTED)
    plan = apply.resolved(decided, suggested, observed)
    done = apply.apply_decided(rows, plan, apply.mappings(value_dictionary(rows, ["kind"])), {"price": "integer"})
    assert sorted(tuple(r) for r in done.rows.collect()) == [(1, "A", "-5", "x", "invalid_value"), (2, "A", "7", "", ""), (3, "A", "n/a", "y", ""), (4, "", "", "y", ""), (5, "", "8", "y", "")]
    assert sorted((r._row_id, r.column, r.original, r.new, r.reason) for r in done.audit.collect()) == [(1, "kind", "a", "A", "standardize"), (4, "kind", "gone", "", "convert_na"), (4, "price", "z", "", "coerce"), (5, "kind", "gone", "", "convert_na")]
    rejected = apply.apply_decided(rows, plan.filter("false"), apply.mappings(value_dictionary(rows, ["kind"])), {})
    assert rejected.rows.exceptAll(rows).isEmpty() and rejected.audit.isEmpty()
    with pytest.raises(ValueError):
        apply.resolved(spark.createDataFrame([(99, "accepted")], "observation_id long, status string"), suggested, observed)
    with pytest.raises(ValueError):
        apply.apply_decided(rows.withColumn("__step_0", F.lit(1)), plan, apply.mappings(value_dictionary(rows, ["kind"])), {})


def test_inference_of_empty_and_odd_columns(spark):
    empty = value_dictionary(spark.createDataFrame([], "_row_id long, a string"), ["a"])
    assert inference.value_patterns(empty).isEmpty() and inference.fused(empty).isEmpty()
    rows = spark.createDataFrame([(1, "", "É1"), (2, "NA", "É2"), (3, "", "É3")], "_row_id long, none string, odd string")
    found = {r.column: r for r in inference.fused(value_dictionary(rows)).collect()}
    assert found["none"].nullable and found["none"].inferred_type is None and found["none"].constraints == "set"
    assert found["odd"].constraints == "not_null,set,unique"


def _visits(spark):
    rows = [(k, f"S{k:02}", "north", "2024-01-01", "2024-02-01", "5") for k in range(12)]
    rows[3] = (3, "S02", "north", "2024-01-01", "2024-02-01", "5")  # S02 again, with the same content
    rows[4] = (4, "S01", "south", "2024-01-01", "2024-02-01", "6")  # S01 again, with another
    rows[5] = (5, "x-5", "South", "2024-03-01", "2024-02-01", "5")  # another shape, a late start
    rows[6] = (6, "S06", "north", "2024-01-01", "2024-02-01", "-7")
    return spark.createDataFrame(rows, "visit long, sample_id string, value string, start_date string, end_date string, count string")


def test_rows_that_observations_are_about(spark):
    found = analyze(_visits(spark), "visit")
    rows = {}
    for r in evidence.about(found, found.observations).join(found.observations, "observation_id").collect():
        rows.setdefault((r.check, r["column"]), set()).add(r._row_id)
    assert rows["identifier", "sample_id"] == {3, 4}
    assert rows["same_row", "_table"] == {3}
    assert rows["near_row", "_table"] == {0, 1, 2, 3, 7, 8, 9, 10, 11}
    assert rows["id_conflict", "sample_id"] == {1, 4}
    assert rows["id_shape", "sample_id"] == {5}
    assert rows["case_variant", "value"] == {4, 5}
    assert rows["late_start_0", "start_date vs end_date"] == {5}
    assert rows["negative", "count"] == {6}
    counted = {r.observation_id: r.n for r in evidence.about(found, found.observations).groupBy("observation_id").agg(F.count("*").alias("n")).collect()}
    for o in found.observations.filter("check not in ('near_row', 'id_conflict', 'typo')").collect():
        assert counted[o.observation_id] == o.occurrences, o


def test_evidence_of_groups(spark):
    found = {(r.check, r["column"]): r for r in evidence.evidence(analyze(_visits(spark), "visit")).withColumn("counts", F.to_json("value_counts")).collect()}
    assert found["case_variant", "value"].counts == '{"south":{"South":1,"south":1}}'
    assert list(found["case_variant", "value"].sample_rows) == [4, 5]
    assert list(found["near_row", "_table"].sample_rows) == [0, 1, 2, 3, 7]
    assert found["same_row", "_table"].value_counts is None


def test_flags_of_all_checks(spark):
    found = analyze(_visits(spark), "visit")
    suggested = curation.suggestions(found.observations).filter("action = 'flag'")
    plan = apply.resolved(decisions.decide(suggested, None, decisions.ACCEPTED), suggested, found.observations)
    rows, marks = evidence.marked(found, found.observations)
    done = {r._row_id: r for r in apply.apply_decided(rows, plan, apply.mappings(found.values), {}, marks).rows.collect()}
    assert {k for k, r in done.items() if r._table_duplicate} == {0, 1, 2, 3, 7, 8, 9, 10, 11}
    assert {k for k, r in done.items() if r.sample_id_duplicate} == {1, 3, 4}
    assert {k for k, r in done.items() if r.cross_column_issue} == {5}
    # -7 is negative, but the later flag of quartiles is written over it.
    assert {k: r.count_flagged for k, r in done.items() if r.count_flagged} == {4: "outlier", 6: "outlier"}
    assert not [c for c in done[0].asDict() if c.startswith("__")]


def test_checks_of_a_user(spark):
    """A check that is registered runs with the others and marks its rows."""
    mine = checks.Check("shouted", "consistency_validator", "inconsistency", lambda t: dict.fromkeys(t.of_type("string")), lambda _: F.col("value").rlike("^[A-Z]{3,}"), lambda t, table, c: [(t.total, "info")])
    df = spark.createDataFrame([(1, "LOUD"), (2, "calm"), (3, "NA"), (4, "LOUDER")], "visit long, word string")
    found = analyze(df, "visit", [*checks.CHECKS, mine])
    seen = found.observations.filter("check = 'shouted'")
    assert [(r["column"], r.occurrences, r.severity) for r in seen.collect()] == [("word", 2, "info")]
    assert sorted(r._row_id for r in evidence.about(found, seen).collect()) == [1, 4]


def test_analysis_of_empty_tables(spark):
    for kind in ("visit long, sample_id string, price string", "visit long"):
        found = analyze(spark.createDataFrame([], kind), "visit")
        assert found.observations.isEmpty()
        assert evidence.evidence(found).isEmpty() and evidence.about(found, found.observations).isEmpty()


def test_clashing_names_of_columns(spark):
    df = spark.createDataFrame([(k, "a" if k else "A", "x", "y", f"k{k}") for k in range(4)], "visit long, value string, text string, `column` string, check string")
    found = analyze(df, "visit")
    seen = found.observations.filter("check = 'case_variant'")
    assert [(r["column"], r.occurrences) for r in seen.collect()] == [("value", 4)]
    assert evidence.about(found, seen).count() == 4


def test_modified_decisions(spark):
    rows = spark.createDataFrame([(1, "a", "-5"), (2, "A", "7.9"), (3, "A", "z")], "_row_id long, kind string, price string")
    observed = spark.createDataFrame([(1, "inconsistency", "warning", "kind", "case_variant_validator", 0.9, 3, 60.0), (2, "outlier", "error", "price", "statistical_outlier_validator", 0.95, 1, 20.0), (3, "type_mismatch", "warning", "price", "type_validator", 0.9, 1, 5.0)], OBSERVED)
    suggested = curation.suggestions(observed)
    decided = decisions.modify(suggested, None, 1)
    decided = decisions.modify(suggested, decided, 2, flag_column="review", flag_value="look")
    decided = decisions.modify(suggested, decided, 3, kind="integer")
    with pytest.raises(ValueError):
        decisions.modify(suggested, decided, 3, kind="float")
    with pytest.raises(ValueError):
        decisions.modify(suggested, None, 3, colour="red")
    plan = apply.resolved(decided, suggested, observed)
    own = spark.createDataFrame([(1, "a", "alpha"), (1, "A", "alpha"), (9, "A", "other")], "observation_id long, value string, new string")
    done = apply.apply_decided(rows, plan, apply.mappings(value_dictionary(rows, ["kind"])), {"price": "float"}, changes_of=own)
    assert sorted(tuple(r) for r in done.rows.collect()) == [(1, "alpha", "-5", "look"), (2, "alpha", "", ""), (3, "alpha", "", "")]
    assert decisions.progress(suggested, decided).first().n_modified == 3


def test_empty_files_are_errors(spark, tmp_path):
    for name, text in (("none", ""), ("blank", "\n\n"), ("header", "a,b\n")):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        with pytest.raises(ValueError):
            delimited.read_delimited(spark, str(path))
        with pytest.raises(ValueError):
            delimited.read_delimited(spark, str(path), ",")


def test_moments_of_texts(spark):
    rows = spark.createDataFrame([(k, v, w) for k, (v, w) in enumerate([("1", "x"), ("2", ""), (" 3", "x"), ("4e1", "n/a"), ("1", "y"), ("-inf", "z")])], "_row_id long, a string, b string")
    (found,) = inference.text_moments(value_dictionary(rows.filter("a <> '-inf'"))).collect()
    assert (found["column"], found.n, found.low, found.high, found.q1, found.median, found.q3) == ("a", 4, 1.0, 40.0, 1.0, 2.0, 2.0)
    assert found.mean == 11.0 and abs(found.std - (1122 / 4) ** 0.5) < 1e-9
    large = spark.createDataFrame([(k, str(10**9 + k % 2)) for k in range(10)], "_row_id long, a string")
    assert inference.text_moments(value_dictionary(large)).first().std == 0.5
    assert inference.text_moments(value_dictionary(rows, ["b"])).isEmpty()


def test_small_mappings_are_broadcast(spark, monkeypatch):
    mapping = spark.createDataFrame([("a", "b"), (None, "c")], "value string, new string")
    hint = lambda: "broadcast" in apply._hinted(mapping)._jdf.queryExecution().logical().toString().lower()
    assert hint()
    monkeypatch.setattr(apply, "BROADCAST_BYTES", 8)
    assert not hint()


def test_cheap_tests_of_forms_lose_nothing(spark):
    """Each form's cheap test holds wherever its pattern does."""
    texts = ["a@b.org", "http://x", "https://x", "0f0f0f0f-0f0f-0f0f-0f0f-0f0f0f0f0f0f", "2024-01-02", "1/2/2024", "11/22/2024", "5551234567", "+1-(555)-123-4567", "+1 (555) 123-4567", "12345", "12345-6789", "AB", "ABC123", "y", "false", "AB12"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for pattern, name in profile.FORMATS:
        fits = F.col("v").rlike(pattern)
        assert df.filter(fits).count() > 0 or name in ("iso_datetime", "sample_id_dotted")
        if name in profile.CHEAP:
            assert df.filter(fits & ~profile.CHEAP[name](F.col("v"))).isEmpty()
