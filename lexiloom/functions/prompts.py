"""Prompts by version and variant, as literals and column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROMPTS = {
    ("judge", "v2", "A"): "Decide how well a property describes a thing, from 0 (never) to 4 (always). Answer with one JSON object.",
    ("judge", "v2", "B"): "Act as a careful reader of dictionaries. Rate from 0 to 4 how typical the property is of the thing. Answer with one JSON object.",
    ("judge", "v2", "C"): "Think of ten examples of the thing. Rate from 0 to 4 for how many of them the property holds. Answer with one JSON object.",
    ("adjudicator", "v2", ""): "Judges disagree about a property of a thing. Weigh their votes and give the final rating from 0 to 4 as one JSON object.",
    ("verifier", "v1", ""): "Check whether a property that was rated positive really holds of the thing. Give the rating from 0 to 4 you would stand by, as one JSON object.",
    ("generation", "v3", "A"): "List up to ten short properties of a thing as JSON.",
    ("generation", "v3", "B"): "Name what people would say a thing is, has or does: up to ten short phrases, as JSON.",
    ("generation", "v3", "C"): "Describe a thing to someone who has never met one, in up to ten short phrases, as JSON.",
    ("generation", "v3.1", "A"): "List up to ten short properties of a thing as JSON. Fewer are fine.",
    ("generation", "v3.1", "B"): "Name what people would say a thing is, has or does, in up to ten short phrases, as JSON. Fewer are fine.",
    ("generation", "v3.1", "C"): "Describe a thing to someone who has never met one, in up to ten short phrases, as JSON. Fewer are fine.",
}
#: Words that would tell a model about the study.
LEAKS = ("memory", "experiment", "study list", "lure", "recall", "recognition")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def load(kind: str, version: str, variant: str = "") -> str:
    if (kind, version, variant) not in PROMPTS:
        raise ValueError(f"no prompt {kind} of version {version} and variant {variant!r}")
    return PROMPTS[kind, version, variant]


def prompt_table(spark: SparkSession) -> DataFrame:
    """(kind, version, variant, text, sha256) of all prompts."""
    return spark.createDataFrame([(*k, t, hashlib.sha256(t.encode()).hexdigest()) for k, t in PROMPTS.items()], "kind string, version string, variant string, text string, sha256 string")


def _by_variant(kind: str, version: str, variant: str | Column) -> Column:
    out = F.lit(None)
    for (k, v, name), text in PROMPTS.items():
        if (k, v) == (kind, version):
            out = F.when(_c(variant) == name, text).otherwise(out)
    return out


def judge_system(variant: str | Column, version: str = "v2") -> Column:
    return _by_variant("judge", version, variant)


def generation_system(variant: str | Column, version: str = "v3") -> Column:
    return _by_variant("generation", version, variant)


def verifier_system(version: str = "v1") -> Column:
    return F.lit(load("verifier", version))


def judge_user(word: str, feature_id: str, text: str) -> Column:
    return F.to_json(F.struct(_c(word).alias("word"), _c(feature_id).alias("feature_id"), _c(text).alias("feature")))


def generation_user(word: str) -> Column:
    return F.to_json(F.struct(_c(word).alias("target_word")))


def verifier_user(word: str, feature_id: str, text: str, value: str) -> Column:
    return F.to_json(F.struct(_c(word).alias("word"), _c(feature_id).alias("feature_id"), _c(text).alias("feature"), F.format_string("%.2f", _c(value)).alias("rating")))


def adjudicator_user(word: str, feature_id: str, text: str, votes: str) -> Column:
    """The votes of ``votes`` (array of judge, value, confidence), one a line."""
    lines = F.transform(_c(votes), lambda v: F.concat(v["judge"], F.lit(": "), F.when(v["value"].isNull(), "none").otherwise(F.format_string("%.2f", v["value"])), F.lit(" (confidence "), F.format_string("%.2f", v["confidence"]), F.lit(")")))
    return F.concat_ws("\n", F.concat(F.lit("Thing: "), _c(word)), F.concat(F.lit("Property "), _c(feature_id).cast("string"), F.lit(": "), _c(text)), F.array_join(lines, "\n"))


def leaks(message: str | Column) -> Column:
    """Whether a message holds one of the words that it must not, as a whole word."""
    return F.regexp_like(F.lower(_c(message)), F.lit(r"\b(" + "|".join(LEAKS) + r")\b"))
