"""Model passes with stand-in clients."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexiloom.operators import models as M
from lexiloom.plans import jobs


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not import tests


def rating(user, digest):
    asked = json.loads(user)
    if asked["feature"] == "broken":
        return "no JSON"
    return json.dumps({"word": asked["word"], "feature_id": asked["feature_id"], "feature_value": 3, "confidence": 0.9, "ambiguous": None, "reason": "r"})


def ratings():
    return M.HashClient(rating)


class Flaky:
    """Fails at first tries, by the seed that tells them from second ones."""

    def generate(self, system, user, seed=None):
        if seed == 0:
            raise M.ModelError("busy")
        return M.Answer(rating(user, 0), "stop")


def test_judges(spark):
    pairs = spark.createDataFrame([("dog", 0, "barks"), ("dog", 1, "broken"), ("dog", 0, "barks")], "word string, feature_id int, feature_text string")
    rows = M.judge_panel(pairs, ratings).collect()
    assert len(rows) == 9 and {r["judge_id"] for r in rows} == {"A", "B", "C"}
    good, bad = [r for r in rows if r["feature_id"] == 0], [r for r in rows if r["feature_id"] == 1]
    assert all(r["value"] == 3.0 and r["parse_error"] == "" and not r["ambiguous"] for r in good)
    assert all(r["value"] is None and r["confidence"] == 0.0 and r["raw_json"] == "no JSON" and r["parse_error"].startswith("JSON parse error") for r in bad)


def test_second_try(spark):
    pairs = spark.createDataFrame([("dog", 0, "barks")], "word string, feature_id int, feature_text string")
    assert [r["value"] for r in M.judge_panel(pairs, Flaky).collect()] == [3.0] * 3


def answer(user, digest):
    asked = json.loads(user)
    value = {"a": 2.0, "b": 0.0}.get(asked["feature"], 9)
    return json.dumps({"word": asked["word"], "feature_id": asked["feature_id"], "verified_feature_value": value, "retain_positive": None, "confidence": 1, "reason": ""})


def test_verifier(spark):
    rows = spark.createDataFrame([("dog", 0, "a", 3.0), ("dog", 1, "b", 2.0), ("dog", 2, "c", 2.0)], "word string, feature_id int, feature_text string, final_value double")
    found = {r["feature_id"]: (r["verified_value"], r["retain_positive"], r["parse_error"] == "") for r in M.verifier(rows, lambda: M.HashClient(answer)).collect()}
    assert found == {0: (2.0, True, True), 1: (0.0, False, True), 2: (None, None, False)}


def listing(user, digest):
    word = json.loads(user)["target_word"]
    return json.dumps({"target_word": word, "features": [f"describes {word}", f"sample feature {digest}"]})


def test_generation_end_to_end(spark):
    words = spark.createDataFrame([("dog",), ("chair",)], "word string")
    plan = jobs.generation_jobs(words, ("A", "B", "C"), 3, 42, "m")
    log = M.generate_features(plan, lambda: M.HashClient(listing))
    assert log.count() == 18 and log.where("parse_error = ''").count() == 18
    assert log.agg(F.sum(F.size("features"))).first()[0] == 36
    assert jobs.pending(plan, log, ["response_id"]).count() == 0
    broken = M.generate_features(plan.limit(1), lambda: M.ReplayClient({})).first()
    assert broken["parse_error"].startswith("Request error: LLM call error: ModelError") and broken["features"] == []


class Stubborn:
    """Answers at the second seed only, and then as told."""

    def __init__(self, second):
        self.second = second

    def generate(self, system, user, seed=None):
        word = json.loads(user)["target_word"]
        if seed < 1_000_000_007:
            return M.Answer("no JSON", "length", 3, 4)
        if self.second == "down":
            raise M.ModelError("down")
        return M.Answer(json.dumps({"target_word": word, "features": ["x"]}), "stop", 3, 9)


def test_generation_tries_again_with_the_retry_seed(spark):
    plan = jobs.generation_jobs(spark.createDataFrame([("dog",)], "word string"), ("A",), 1, 42, "m").withColumn("sampling_seed", F.lit(4).cast("long"))
    row = M.generate_features(plan, lambda: Stubborn("")).first()
    assert (row["features"], row["parse_error"], row["sampling_seed"], row["finish_reason"], row["prompt_tokens"], row["completion_tokens"], row["n_features"]) == (["x"], "", 1_000_000_011, "stop", 3, 9, 1)
    row = M.generate_features(plan, lambda: Stubborn("down")).first()
    assert (row["features"], row["parse_error"], row["sampling_seed"], row["raw_json"]) == ([], "Request error: LLM call error: ModelError: down", 4, "")


def test_rows_of_a_run_have_numbers_of_their_own(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(60)], "word string").repartition(9)
    log = M.generate_features(jobs.generation_jobs(words, ("A", "B"), 2, 42, "m"), lambda: M.HashClient(listing), run_id=3)
    found = [r["ingest_seq"] for r in log.collect()]
    assert sorted(found) == [(3 << 40) + i for i in range(240)]


def test_prompt_hash_follows_the_messages(spark):
    words = spark.createDataFrame([("dog",)], "word string")
    one, other = (jobs.generation_jobs(words, ("A",), 1, 42, "m", version=v).first() for v in ("v3", "v3.1"))
    assert one["prompt_hash"] != other["prompt_hash"] and one["response_id"] != other["response_id"] and one["sampling_seed"] == other["sampling_seed"]
    with pytest.raises(ValueError):
        jobs.generation_jobs(words, ("D",), 1, 42, "m")


class Unsure:
    """A verifier that answers at its second try only, or never."""

    def generate(self, system, user, seed=None):
        if seed == 0 or "never" in user:
            return M.Answer("?")
        return M.Answer(answer(user, 0))


def test_verifier_tries_twice(spark):
    rows = spark.createDataFrame([("dog", 0, "a", 3.0), ("never", 1, "a", 2.0)], "word string, feature_id int, feature_text string, final_value double")
    found = {r["word"]: (r["verified_value"], r["parse_error"] == "") for r in M.verifier(rows, Unsure).collect()}
    assert found == {"dog": (2.0, True), "never": (None, False)}


def test_adjudicators_are_asked_once(spark, tmp_path):
    folder = str(tmp_path)

    class Counted:
        def generate(self, system, user, seed=None):
            import uuid

            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            assert seed is None and "A: 3.00 (confidence 0.90)" in user and "B: none" in user
            return M.Answer(json.dumps({"word": "dog", "feature_id": 4, "feature_value": 2, "confidence": 1, "ambiguous": False, "reason": ""}))

    votes = spark.createDataFrame([("dog", 4, "A", 3.0, 0.9, False, ""), ("dog", 4, "B", None, 0.0, False, "bad")], "word string, feature_id int, judge_id string, value double, confidence double, ambiguous boolean, parse_error string")
    pairs = spark.createDataFrame([("dog", 4, "barks")], "word string, feature_id int, feature_text string")
    rows = M.adjudicators(pairs, votes, Counted).collect()
    assert sorted(r["judge_id"] for r in rows) == ["1", "2", "3"] and all(r["value"] == 2.0 for r in rows)
    assert len(list(tmp_path.iterdir())) == 1


def test_http_client_retries_and_caches(monkeypatch):
    client = M.HttpClient("http://localhost:1/", "m", retries=3, pause=0, max_tokens=50, response_format={"type": "json_object"}, cached=2)
    bodies = []

    def post(body):
        bodies.append(body)
        if len(bodies) < 3:
            raise OSError("down")
        return {"choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 5, "completion_tokens": 1}}

    monkeypatch.setattr(client, "_post", post)
    assert client.generate("", "u", 7) == ("hi", "stop", 5, 1) == client.generate("", "u", 7)
    assert bodies[0]["max_tokens"] == 50 and bodies[0]["response_format"] == {"type": "json_object"}
    assert len(bodies) == 3 and bodies[0]["messages"] == [{"role": "user", "content": "u"}] and bodies[0]["seed"] == 7
    client.generate("s", "u", 8)
    assert len(bodies) == 4 and len(bodies[3]["messages"]) == 2
    client.generate("s", "u", 9)  # the oldest answer is forgotten
    client.generate("", "u", 7)
    assert len(bodies) == 6 and len(client.cache) == 2
    monkeypatch.setattr(client, "_post", lambda body: 1 / 0)
    with pytest.raises(M.ModelError):
        client.generate("s", "other")


def test_cache_key():
    key = M.cache_key("s", "u", "m", 0.0, 1)
    assert key == M.cache_key("s", "u", "m", 0.0, 1) and key != M.cache_key("s", "u", "m", 0.0, 2)
