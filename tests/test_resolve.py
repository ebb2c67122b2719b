"""Disagreement, resolution, adjudication and verification."""

import random
from collections import Counter
from itertools import combinations

import pytest

from lexiloom.operators import resolve as R

VOTES = "word string, judge_id string, value double, confidence double, ambiguous boolean, parse_error string"


def panel(spark, cases):
    rows = [(str(i), "ABC"[j], None if v is None else float(v), c, a, e) for i, case in enumerate(cases) for j, (v, c, a, e) in enumerate(case)]
    return spark.createDataFrame(rows, VOTES)


def case(values, confidences=(0.8, 0.8, 0.8), ambiguous=(False,) * 3, errors=("",) * 3):
    return [*zip(values, confidences, ambiguous, errors)]


TABLE = [
    (case((3, 3, 2), (0.9, 0.85, 0.5)), None),
    (case((3, 3, 2), (0.9, 0.85, 0.85)), "high_confidence_dissent"),
    (case((0, 2, 2)), "range_2.0"),
    (case((0, 3, 3)), "range_3.0"),
    (case((0, 4, 4)), "range_4.0"),
    (case((0, 2.25, 1)), "range_2.2"),
    (case((3, 3, None), errors=("", "", "bad")), "parse_error"),
    (case((3, 3, None)), "insufficient_valid_votes"),
    (case((2, 2, 2), (0.5,) * 3, (True, True, False)), "ambiguous_majority"),
    (case((2, 2, 2), (0.5,) * 3, (True, False, False)), None),
    (case((2.4, 2.0, 1.6), (0.9,) * 3), None),
]


def test_triggers(spark):
    df = R.gather(panel(spark, [c for c, _ in TABLE]), ["word"])
    found = {int(r["word"]): r["t"] for r in df.select("word", R.trigger().alias("t")).collect()}
    assert [found[i] for i in range(len(TABLE))] == [t for _, t in TABLE]


def test_first_pass(spark):
    cases = [case((3, 3, 2)), case((2.4, 2.0, 1.6)), case((None,) * 3), case((None, 1.2, 1.3))]
    out = R.gather(panel(spark, cases), ["word"]).select("word", R.first_pass().alias("r")).collect()
    found = {r["word"]: tuple(r["r"]) for r in out}
    assert found["0"] == (pytest.approx(8 / 3), "mean_small_disagreement", False)
    assert found["1"] == (2.4, "unanimous", False) and found["2"] == (None, "failed", True) and found["3"] == (1.2, "unanimous", False)


def plain_adjudicate(values):
    v = [x for x in values if x is not None]
    if not v:
        return None, "adjudicator_failed", True
    if len(v) == 1:
        return v[0], "adjudicator_single", False
    near = [x for p in combinations(v, 2) if abs(p[0] - p[1]) <= 0.5 for x in p]
    return (sum(near) / len(near), "adjudicator_agree", False) if near else (sum(v) / len(v), "adjudicator_disagree_provisional_mean", True)


def test_adjudication(spark):
    rng = random.Random(2)
    rows = [[2.0, 2.4, 2.8], [0.0, 2.0, 4.0], [1.0, None, None], [None] * 3, [3.0, None, 3.0], []] + [[rng.choice([None, *[x / 4 for x in range(17)]]) for _ in range(3)] for _ in range(60)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<double>")
    for r in df.select("i", R.adjudicate("v").alias("r")).collect():
        value, method, audit = plain_adjudicate(rows[r["i"]])
        assert (r["r"]["method"], r["r"]["needs_audit"]) == (method, audit)
        assert r["r"]["final_value"] == (None if value is None else pytest.approx(value))
    assert [*plain_adjudicate([2.0, 2.4, 2.8])][0] == pytest.approx(2.4)


def plain_trigger(votes):
    if any(e for *_, e in votes):
        return "parse_error"
    v = [x for x, *_ in votes if x is not None]
    if len(v) < 3:
        return "insufficient_valid_votes"
    if max(v) - min(v) >= 2:
        return f"range_{max(v) - min(v):.1f}"
    r = [round(x) for x in v]
    if len({*r}) > 1:
        n = Counter(r)
        major = min(x for x in n if n[x] == max(n.values()))
        if any(round(x) != major and c >= 0.8 for x, c, *_ in votes):
            return "high_confidence_dissent"
    return "ambiguous_majority" if sum(a for _, _, a, _ in votes) >= 2 else None


def test_random_votes_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    cases = [[(rng.choice([None, *[x / 4 for x in range(17)]]), rng.choice([0.5, 0.8, 0.9]), rng.random() < 0.4, rng.choice(["", "", "", "", "e"])) for _ in range(3)] for _ in range(200)]
    df = panel(spark, cases)
    for n in (1, 7):
        found = {int(r["word"]): r["t"] for r in R.gather(df.repartition(n), ["word"]).select("word", R.trigger().alias("t")).collect()}
        assert [found[i] for i in range(200)] == [plain_trigger(c) for c in cases]


def test_resolve_and_verify(spark):
    votes = panel(spark, [case((3, 3, 3)), case((0, 4, 4)), case((0, 0, 0)), case((0, 3, 3))])
    extra = spark.createDataFrame([("1", "x", 2.0), ("1", "y", 2.4), ("1", "z", 2.8)], "word string, judge_id string, value double")
    out = R.resolve(votes, extra, ["word"])
    found = {r["word"]: r for r in out.collect()}
    assert (found["0"]["final_value"], found["0"]["adjudicated"]) == (3.0, False)
    assert found["1"]["final_value"] == pytest.approx(2.4) and found["1"]["adjudication_trigger"] == "range_4.0"
    assert (found["3"]["method"], found["3"]["needs_audit"]) == ("adjudicator_failed", True)
    answers = spark.createDataFrame([("0", 0.5), ("1", 2.5)], "word string, verified_value double")
    merged = {r["word"]: r for r in R.verify(out, answers, ["word"]).collect()}
    assert [merged[w]["verification_status"] for w in "0123"] == ["rejected", "retained", "not_candidate", "not_candidate"]
    assert [merged[w]["final_value"] for w in "012"] == [0.0, 2.5, 0.0]
    none = {r["word"]: r for r in R.verify(out, answers.limit(0), ["word"]).collect()}
    assert (none["0"]["verification_status"], none["0"]["final_value"], none["0"]["needs_audit"]) == ("parse_error", 3.0, True)
    assert R.resolve(votes.limit(0), None, ["word"]).count() == 0


def test_summaries(spark):
    row = R.summarise(R.gather(panel(spark, [case((1, 2, 2.5))]), ["word"])).first()
    assert (row["n_valid"], row["min_value"], row["max_value"], row["value_range"], row["mode_value"]) == (3, 1.0, 2.5, 1.5, 2.0)
