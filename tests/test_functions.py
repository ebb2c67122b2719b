"""Scalar functions and JSON rules against Python's own semantics."""

import hashlib
import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import json_rules as J
from lexiloom.functions import prompts
from lexiloom.functions import text as T

WORDS = ["  Café  au\tLait ", "STRASSE", "Straße", "ñandú", "Ångström", "a b", "été", "", "ok", "İx", "日本 語", "한국", "x\x1cy", " \n ", None]


def python_word(x):
    bare = "".join(c for c in unicodedata.normalize("NFD", x.strip()) if unicodedata.category(c) != "Mn")
    return " ".join(bare.lower().split())


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", expr.alias("y")).orderBy("i").select("y").collect()]


def test_normalize_word(spark):
    native = [w for w in WORDS if w is None or "한" not in w and "İ" not in w]
    assert column(spark, native, T.normalize_word("x")) == [None if w is None else python_word(w) for w in native]


def test_normalize_exact_takes_python_where_needed(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "i int, x string")
    found = {r["i"]: r["y"] for r in T.normalize_exact(df, "x", "y").collect()}
    assert found == {i: None if w is None else python_word(w) for i, w in enumerate(WORDS)}


def test_normalize_feature(spark):
    cases = {"Has Fur.": "has fur", "a. .": "a.", "  x  y... ": "x y", "Straße": "strasse", ".": "", "a.b": "a.b"}
    assert column(spark, [*cases], T.normalize_feature("x")) == [*cases.values()]


def test_casefold_of_every_character(spark):
    """Alone, and where the character before and after it may matter."""
    chars = [chr(cp) for cp in range(0x110000) if not 0xD800 <= cp < 0xE000 and unicodedata.category(chr(cp)) not in ("Cn", "Co")]
    for texts in (chars, [f"A{c}b" for c in chars if c.casefold() != c], ["ΟΔΟΣ", "ὈΔΌΣ ΣΑΣ", "ﬁsh", "ŉ", "STRAẞE", "İstanbul", "Ꭰꭰ", ""]):
        found = column(spark, texts, T.casefold("x"))
        assert [(a, b) for a, b in zip(texts, found) if a.casefold() != b] == []


def test_match_key(spark):
    assert column(spark, ["Bat (animal)", "bat  animal", "BAT ( animal )"], T.match_key("x")) == ["bat animal"] * 3


def test_distinct_features(spark):
    rows = [["Has fur", "has  FUR", " ", "is a pet", "Is A Pet", "x"], [], None]
    assert column(spark, rows, T.distinct_features("x"), "array<string>") == [["Has fur", "is a pet", "x"], [], None]


def test_fences_and_literals(spark):
    assert column(spark, ["```json\n{}\n```", "no fence ```", "  ```\na\n  ```x\nb"], T.strip_fence("x")) == ["{}", "no fence ```", "a\nb"]
    assert column(spark, ['{"a": None, "b": True}', '"None"', '"is None here"', "Nonesuch"], T.json_literals("x")) == ['{"a": null, "b": true}', '"None"', '"is null here"', "Nonesuch"]


def test_hashes_and_seeds(spark):
    df = spark.createDataFrame([("dog", 3)], "w string, f int")
    row = df.select(T.row_hash("w", "f"), T.prompt_hash(F.lit("s"), F.lit("u")), T.sampling_seed(42, "w", "f"), T.response_id("w", F.lit("A"), "f"), T.retry_seed(F.lit(9223372036854775800), 1)).first()
    sha = lambda s: hashlib.sha256(s.encode())
    assert row[0] == sha("dog|3").hexdigest() and row[1] == sha("s\n---\nu").hexdigest() and row[3] == sha("dog|A|3").hexdigest()
    assert row[2] == int.from_bytes(sha("42|dog|3").digest()[:8], "big") & 0x7FFFFFFFFFFFFFFF
    assert row[4] == (9223372036854775800 + 1_000_000_007) & 0x7FFFFFFFFFFFFFFF


def test_rounding_routing_and_truth(spark):
    assert column(spark, [0.5, 1.5, 2.5, -0.5], T.half_even("x"), "double") == [0, 2, 2, 0]
    assert column(spark, ["2", "0.5", "x", None], T.routing("x")) == ["candidate", "not_candidate", "not_candidate", "not_candidate"]
    assert column(spark, ["True", "1", "yes", "1.0", "no", None], T.truthy("x")) == [True, True, True, False, False, False]
    assert column(spark, [0.8, 0.79, None], T.high_confidence("x"), "double") == [True, False, False]


def judged(spark, raws, word="dog", fid=3):
    out = column(spark, raws, J.validate_judgement(F.col("x"), F.lit(word), F.lit(fid)))
    return [(r["parse_error"], r["record"]) for r in out]


def good(**changes):
    return {"word": "dog", "feature_id": 3, "feature_value": 2, "confidence": 0.9, "ambiguous": False, "reason": "r"} | changes


def test_judgements(spark):
    d = json.dumps
    less = good()
    del less["confidence"]
    missing = good()
    del missing["ambiguous"]
    cases = [
        (d(good()), True), ("```json\n" + d(good()) + "\n```", True), (d(good(word=" DOG ")), True), (d(good(ambiguous=None)), True), (d(missing), True), (d(good(feature_value=0)), True), (d(good(feature_value=4.0)), True),
        (str(good(ambiguous=None)).replace("'", '"'), True),
        (d(good(feature_value=4.5)), False), (d(good(feature_value=-1)), False), (d(good(confidence=1.1)), False), (d(good(feature_value=True)), False), (d(good(feature_value="2")), False), (d(good(more=1)), False), (d(less), False),
        (d(good(word="cat")), False), (d(good(feature_id=4)), False), (d(good(feature_id=3.5)), False), (d(good(reason="x" * 301)), False), (d(good()) + " x", False), (d(good()) + d(good()), False), ("", False), (None, False), ("[1]", False), ("3", False), (d(good())[:-1], False),
    ]
    found = judged(spark, [c for c, _ in cases])
    assert [e == "" for e, _ in found] == [ok for _, ok in cases]
    assert all((r is None) != (e == "") for e, r in found)
    assert [e.split(":")[0] for e, _ in found[-5:]] == ["JSON parse error"] * 2 + ["Schema validation error"] * 2 + ["JSON parse error"]
    assert judged(spark, [d(good(reason="y" * 200))])[0][1]["reason"] == "y" * 177 + "..."


def test_verifications(spark):
    base = {"word": "dog", "feature_id": 3, "verified_feature_value": 2, "retain_positive": False, "confidence": 0.5, "reason": "r"}
    less = dict(base)
    del less["retain_positive"]
    raws = [json.dumps(base), json.dumps(base | {"retain_positive": None}), json.dumps(less), json.dumps(base | {"verified_feature_value": 0.5, "retain_positive": True}), json.dumps(base | {"reason": "x" * 181})]
    out = column(spark, raws, J.validate_verification(F.col("x"), F.lit("dog"), F.lit(3)))
    assert [r["parse_error"] == "" for r in out] == [True, True, False, True, False]
    assert [r["record"]["retain_positive"] for r in out if r["record"]] == [True, True, False]


def test_generations(spark):
    make = lambda **x: json.dumps({"target_word": "dog (animal)", "features": ["Has fur", "has fur", "is a pet"]} | x)
    raws = [make(), make(target_word="Dog animal"), make(target_word="cat"), make(feature_id=1), make(features=[]), make(features=["x"] * 11), make(features=[""]), make(features=["y" * 101]), make(features=[1]), make(features="x")]
    out = column(spark, raws, J.validate_generation(F.col("x"), F.lit("dog (animal)")))
    assert [r["parse_error"] == "" for r in out] == [True, True, False, False, True, False, False, False, False, False]
    assert out[0]["record"]["features"] == ["Has fur", "is a pet"]


def test_prompts(spark):
    assert prompts.load("judge", "v2", "A") != prompts.load("judge", "v2", "B")
    for bad in (("judge", "v3", "A"), ("generation", "v3", "D"), ("poet", "v1", "")):
        with pytest.raises(ValueError):
            prompts.load(*bad)
    table = prompts.prompt_table(spark).collect()
    assert all(r["sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in table) and len(table) == len(prompts.PROMPTS)
    assert column(spark, ["a casserole", "the memory test", "parole board"], prompts.leaks("x")) == [False, True, False]
    assert not any(prompts.LEAKS[0] in t for t in prompts.PROMPTS.values())
    votes = spark.createDataFrame([([("A", 2.0, 0.5), ("B", None, 0.0)],)], "v array<struct<judge:string,value:double,confidence:double>>")
    assert votes.select(prompts.adjudicator_user(F.lit("dog"), F.lit(3), F.lit("barks"), "v")).first()[0] == "Thing: dog\nProperty 3: barks\nA: 2.00 (confidence 0.50)\nB: none (confidence 0.00)"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aAéÉßñ .\t ", max_size=8), min_size=1, max_size=20))
def test_normalize_feature_at_random(spark, values):
    import re

    def plain(x):
        return " ".join(re.sub(r"\.+$", "", x.casefold().strip()).split())

    assert column(spark, values, T.normalize_feature("x")) == [*map(plain, values)]
