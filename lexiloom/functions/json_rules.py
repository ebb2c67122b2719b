"""Validation of structured responses without a Python UDF.

A text is stripped of code fences and Python literals and parsed as a variant
inside brackets, so that anything behind the object is an error. Keys, types,
ranges and lengths are checked on the variant; each validator returns a struct
of the record's fields (null if invalid) and ``parse_error`` ('' if valid).
Duplicate keys and NaN are errors. An error names its class, not a library's text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import distinct_features, json_literals, match_key, strip, strip_fence


@dataclass(frozen=True)
class Rule:
    kind: str  # number, integer, boolean, string or strings
    low: float | None = None
    high: float | None = None
    optional: bool = False  # missing or null counts as false
    nullable: bool = False  # null counts as false, missing is an error


# Fields and limits of the three response schemas.
JUDGE = {
    "word": Rule("string", 1),
    "feature_id": Rule("integer", 0),
    "feature_value": Rule("number", 0, 4),
    "confidence": Rule("number", 0, 1),
    "ambiguous": Rule("boolean", optional=True),
    "reason": Rule("string", None, 300),
}
VERIFIER = {
    "word": Rule("string", 1),
    "feature_id": Rule("integer", 0),
    "verified_feature_value": Rule("number", 0, 4),
    "retain_positive": Rule("boolean", nullable=True),
    "confidence": Rule("number", 0, 1),
    "reason": Rule("string", None, 180),
}
GENERATION = {"target_word": Rule("string", 1), "features": Rule("strings", None, 10)}
FEATURE_LENGTH = 100


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def cleaned(raw: Column) -> Column:
    return json_literals(strip_fence(F.coalesce(raw, F.lit(""))))


def parsed(text: Column) -> Column:
    """The text's variant, or null if it is not exactly one JSON value."""
    boxed = F.concat(F.lit("["), text, F.lit("]"))
    return F.when(F.json_array_length(boxed) == 1, F.try_variant_get(F.try_parse_json(boxed), "$[0]", "variant"))


def _kind(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))


def _number(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "double")


def _ok(v: Column, key: str, rule: Rule) -> Column:
    kind = _kind(v, key)
    null = kind == "VOID"
    numeric = F.regexp_like(kind, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    value = _number(v, key)
    inside = F.lit(True)
    if rule.kind in ("number", "integer"):
        if rule.low is not None:
            inside &= value >= rule.low
        if rule.high is not None:
            inside &= value <= rule.high
        if rule.kind == "integer":
            inside &= value == F.floor(value)
        good = numeric & inside
    elif rule.kind == "boolean":
        good = kind == "BOOLEAN"
    elif rule.kind == "string":
        size = F.length(F.try_variant_get(v, f"$.{key}", "string"))
        good = (kind == "STRING") & (size >= int(rule.low or 0)) & (size <= int(rule.high or 1 << 30))
    else:
        items = F.try_variant_get(v, f"$.{key}", "array<string>")
        sizes = F.forall(items, lambda t: t.isNotNull() & (F.length(t) >= 1) & (F.length(t) <= FEATURE_LENGTH))
        good = (kind.isin("ARRAY<STRING>", "ARRAY<VOID>")) & (F.size(items) <= int(rule.high)) & sizes
    if rule.nullable or rule.optional:
        good |= null
    return F.coalesce(good, F.lit(rule.optional) & kind.isNull())


def schema_error(text: Column, v: Column, rules: dict[str, Rule]) -> Column:
    """'' or the first rule that is broken: a missing or unknown key, or a field of the wrong type or size."""
    keys = F.json_object_keys(text)
    required = [k for k, r in rules.items() if not r.optional]
    checks = F.when(v.isNull(), "JSON parse error: not one JSON value")
    checks = checks.when(~F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)), "Schema validation error: not an object")
    checks = checks.when(F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0, "Schema validation error: missing key")
    checks = checks.when(F.size(F.array_except(keys, F.array(*map(F.lit, rules)))) > 0, "Schema validation error: unknown key")
    for key, rule in rules.items():
        checks = checks.when(~_ok(v, key, rule), f"Schema validation error: {key}")
    return checks.otherwise("")


def _result(error: Column, **fields: Column) -> Column:
    return F.struct(F.when(error == "", F.struct(*[c.alias(k) for k, c in fields.items()])).alias("record"), error.alias("parse_error"))


def _checked(raw: Column, rules: dict[str, Rule], rest: Callable[[Column, Column], Column]) -> Column:
    """``rest`` of the error so far and the variant; text, variant and error are computed once."""
    def of(text: Column) -> Column:
        return _let(parsed(text), lambda v: _let(schema_error(text, v, rules), lambda error: rest(error, v)))

    return _let(cleaned(raw), of)


def _get(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _pair_error(error: Column, v: Column, word: Column, feature_id: Column) -> Column:
    other = F.lower(strip(_get(v, "word", "string"))) != F.lower(strip(word))
    return F.when(error != "", error).when(other, "Returned word does not match").when(_number(v, "feature_id") != feature_id, "Returned feature_id does not match").otherwise("")


def validate_judgement(raw: Column, word: Column, feature_id: Column, most_reason: int = 180) -> Column:
    """A judge's vote. Words are compared stripped and in lower case; long reasons are cut."""
    def rest(error: Column, v: Column) -> Column:
        reason = _get(v, "reason", "string")
        reason = F.when(F.length(reason) > most_reason, F.concat(F.substring(reason, 1, most_reason - 3), F.lit("..."))).otherwise(reason)
        return _result(_pair_error(error, v, word, feature_id), feature_value=_number(v, "feature_value"), confidence=_number(v, "confidence"), ambiguous=F.coalesce(_get(v, "ambiguous", "boolean"), F.lit(False)), reason=reason)

    return _checked(raw, JUDGE, rest)


def validate_verification(raw: Column, word: Column, feature_id: Column, threshold: float = 1.0) -> Column:
    """A verifier's answer; retain_positive follows from the value, whatever the answer says."""
    def rest(error: Column, v: Column) -> Column:
        value = _number(v, "verified_feature_value")
        return _result(_pair_error(error, v, word, feature_id), verified_feature_value=value, retain_positive=value >= threshold, confidence=_number(v, "confidence"), reason=_get(v, "reason", "string"))

    return _checked(raw, VERIFIER, rest)


def validate_generation(raw: Column, word: Column) -> Column:
    """A list of features for a target word, each once whatever its case."""
    def rest(error: Column, v: Column) -> Column:
        target = _get(v, "target_word", "string")
        error = F.when(error != "", error).when(match_key(target) != match_key(word), "Returned target_word does not match").otherwise("")
        return _result(error, target_word=target, features=distinct_features(_get(v, "features", "array<string>")))

    return _checked(raw, GENERATION, rest)
