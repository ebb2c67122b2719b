"""Whole passes with stand-in clients."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexiloom.operators import models as M
from lexiloom.operators import passes
from lexiloom.plans import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not import tests


class Generator:
    """Fails for one word, until told otherwise."""

    def __init__(self, broken=""):
        self.broken = broken

    def generate(self, system, user, seed=None):
        word = json.loads(user)["target_word"]
        if word == self.broken:
            return M.Answer('{"target_word": "chair", "features": ["is wood"]', "stop")
        return M.Answer(json.dumps({"target_word": word, "features": [f"describes {word}", f"sample feature {seed % 2}"]}), "stop", 1, 2)


def test_generation_resumes_and_derives(spark):
    words = spark.createDataFrame([("Dog",), ("Chair",), ("Dog",)], "word string")
    run = lambda log, run_id, broken: passes.run_generation(words, lambda: Generator(broken), ("A", "B", "C"), 3, 42, "m", log=log, run_id=run_id)
    first = run(None, 1, "chair")
    assert (first.log.count(), first.pending, first.long.count()) == (18, 9, 18)
    second = run(first.log, 2, "")
    assert (second.log.count(), second.pending, second.long.count()) == (27, 0, 36)
    third = run(second.log, 3, "")
    assert (third.log.count(), third.pending) == (27, 0)
    row = third.frequencies.where("prompt_variant = 'A' and feature_text_normalized = 'describes dog'").first()
    assert (row["response_frequency"], row["valid_response_count"], row["response_proportion"]) == (3, 3, 1.0)
    found = {r["prompt_variant"]: (r["log_rows"], r["responses"], r["valid"], r["failed"]) for r in third.counters.collect()}
    assert found == {v: (9, 6, 6, 0) for v in "ABC"}
    assert third.log.select("ingest_seq").distinct().count() == 27
    with pytest.raises(jobs.DriftError):
        passes.run_generation(words, Generator, ("A",), 1, 42, "m", manifest={"model": "other"})
    with pytest.raises(ValueError):
        passes.run_generation(words, Generator, ("A",), 2, 42, "m", temperature=0.0)


def test_revalidation_rebuilds(spark):
    words = spark.createDataFrame([("dog",), ("chair",)], "word string")
    done = passes.run_generation(words, lambda: Generator("chair"), ("A",), 2, 42, "m")
    # The raw texts were cut by the client; say that they were not.
    log = done.log.withColumn("raw_json", F.regexp_replace("raw_json", r"\]$", "]}"))
    found = passes.run_revalidation(log, {"total_planned_responses": 4, "x": 1}, "now")
    assert found.log.count() == 6 and found.long.count() == 6 and found.backup == {"total_planned_responses": 4, "x": 1}
    assert found.manifest["valid_responses_total"] == 4 and found.manifest["pending_after_run"] == 0 and found.manifest["parse_errors_total"] == 0
    assert found.manifest["revalidation_history"] == [{"revalidated_at": "now", "candidate_errors": 2, "repaired_responses": 2, "unresolved_responses": 0, "method": "raw texts parsed again; no model calls"}]
    again = passes.run_revalidation(found.log, found.manifest, "later")
    assert again.log.count() == 6 and again.backup is None and again.manifest["revalidated_responses_total"] == 2 and len(again.manifest["revalidation_history"]) == 2


class Panel:
    """Judges who differ about one feature, adjudicators who settle it, and a verifier who rejects another."""

    def generate(self, system, user, seed=None):
        if not user.startswith("{"):
            return M.Answer(json.dumps({"word": "dog", "feature_id": 1, "feature_value": 2.5, "confidence": 1, "ambiguous": False, "reason": ""}))
        asked = json.loads(user)
        body = {"word": asked["word"], "feature_id": asked["feature_id"], "confidence": 0.9, "reason": ""}
        if "rating" in asked:
            return M.Answer(json.dumps(body | {"verified_feature_value": 0 if asked["feature_id"] == 2 else 3, "retain_positive": True}))
        value = 4 if asked["feature_id"] == 1 and "dictionaries" in system else 0 if asked["feature_id"] in (1, 3) else 3
        return M.Answer(json.dumps(body | {"feature_value": value, "ambiguous": False}))


def test_labelling_end_to_end(spark):
    pairs = spark.createDataFrame([("dog", i, f"f{i}") for i in range(4)], "word string, feature_id int, feature_text string")
    found = passes.run_labelling(pairs, Panel)
    rows = {r["feature_id"]: (r["final_value"], r["method"], r["adjudicated"], r["verification_status"], r["needs_audit"]) for r in found.resolutions.collect()}
    assert rows == {
        0: (3.0, "unanimous", False, "retained", False),
        1: (3.0, "adjudicator_agree", True, "retained", False),
        2: (0.0, "unanimous", False, "rejected", False),
        3: (0.0, "unanimous", False, "not_candidate", False),
    }
    assert found.votes.count() == 12 and found.adjudications.count() == 3
    again = passes.run_labelling(pairs, lambda: M.ReplayClient({}), found.votes, verify=False)
    assert again.votes.count() == 12 and again.resolutions.where("feature_id = 1").first()["method"] == "adjudicator_failed"


def test_expansion_end_to_end(spark):
    original = spark.createDataFrame([("Dog", 4.0, 0.0), ("cat", 4.0, 3.0)], "Name string, `is an animal` double, `has legs` double")
    items = spark.createDataFrame([(0, "Sleep"), (1, "dream"), (2, "DOG"), (3, "rest")], "input_seq int, word string")
    resolutions = spark.createDataFrame([("sleep", 0, 0.0, False, False), ("sleep", 1, 2.5, True, True), ("dream", 1, None, False, False), ("dog", 0, 1.0, False, False), ("sleep", 7, 9.0, False, False)], "word_normalized string, feature_id int, final_value double, adjudicated boolean, needs_audit boolean")
    rows = {r["word_normalized"]: r for r in passes.run_expansion(original, "Name", items, resolutions).collect()}
    assert sorted(rows) == ["cat", "dog", "dream", "rest", "sleep"]
    assert (rows["dog"]["word"], rows["dog"]["source"], rows["dog"]["is an animal"], rows["dog"]["n_adjudicated"]) == ("Dog", "original", 4.0, None)
    assert (rows["sleep"]["word"], rows["sleep"]["is an animal"], rows["sleep"]["has legs"], rows["sleep"]["n_adjudicated"], rows["sleep"]["needs_human_audit"]) == ("Sleep", 0.0, 2.5, 1, True)
    assert (rows["rest"]["has legs"], rows["rest"]["n_positive_features"], rows["rest"]["needs_human_audit"], rows["rest"]["mean_feature_confidence"]) == (0.0, 0, False, 0.0)


def test_geometry_report(spark):
    same = spark.createDataFrame([(i, "ab"[i % 2], [float(i % 3), 1.0, float(i)], [float(i % 3), 1.0, float(i)]) for i in range(6)], "item long, c string, gold array<double>, pred array<double>")
    row = passes.geometry(same, "item", "c").first()
    assert row["n_items"] == 6 and row["mean_cosine"] == pytest.approx(1) and row["median_cosine"] == pytest.approx(1) and row["pairwise_pearson"] == pytest.approx(1) and row["pairwise_spearman"] == pytest.approx(1)
    assert row["mean_nn_jaccard"] == 1.0 and row["gold_separation"] == pytest.approx(row["pred_separation"]) and row["prevalence_pearson"] == pytest.approx(1)
    assert passes.geometry(same, "item").first()["gold_separation"] is None


def test_geometry_report_of_many_items_lists_no_pairs(spark, monkeypatch):
    from lexiloom.operators import metrics

    def listed(*args, **more):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(metrics, "pair_similarities", listed)
    df = spark.range(4001).selectExpr("id as item", "string(id % 3) as c", "array(sin(id), cos(3 * id), sin(7 * id + 1)) as gold").withColumn("pred", F.col("gold"))
    row = passes.geometry(df, "item", "c").first()
    assert row["n_items"] == 4001 and row["pairwise_spearman"] == pytest.approx(1) and row["mean_nn_jaccard"] == 1.0
