"""Resolution of judges' votes: disagreement, adjudication and verification.

A pair's votes are gathered once, as an array in the judges' order (three of
them, so it is bounded); all rules are expressions over that array, and one
exchange on the pair serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import half_even, routing

DISSENT = 0.80
RANGE = 2.0
AGREE = 0.5


def gather(votes: DataFrame, pair: list[str], judge: str = "judge_id") -> DataFrame:
    """(pair, votes) with the votes in the judges' order; value, confidence, ambiguous and parse_error are read."""
    vote = F.struct(F.col(judge).alias("judge"), F.col("value").cast("double").alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), (F.coalesce(F.col("parse_error").cast("string"), F.lit("")).isin("", "false") == F.lit(False)).alias("failed"))
    return votes.groupBy(*pair).agg(F.sort_array(F.collect_list(vote)).alias("votes"))


def values_of(votes: str | Column) -> Column:
    votes = F.col(votes) if isinstance(votes, str) else votes
    return F.filter(F.transform(votes, lambda v: v["value"]), lambda x: x.isNotNull())


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))


def _mode(rounded: Column) -> Column:
    """The most frequent value; of several, the smallest."""
    counted = F.transform(F.array_distinct(rounded), lambda x: F.struct((-F.size(F.filter(rounded, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.array_min(counted)["x"]


def summarise(df: DataFrame, votes: str = "votes") -> DataFrame:
    """Adds n_valid, min_value, max_value, value_range, mean_value and mode_value."""
    v = values_of(votes)
    return df.withColumn("__v", v).withColumns({
        "n_valid": F.size("__v"),
        "min_value": F.array_min("__v"),
        "max_value": F.array_max("__v"),
        "value_range": F.array_max("__v") - F.array_min("__v"),
        "mean_value": _mean(F.col("__v")),
        "mode_value": _mode(F.transform("__v", lambda x: half_even(x))),
    }).drop("__v")


def trigger(votes: str | Column = "votes") -> Column:
    """Why a pair needs adjudication, or null. The first rule that holds counts."""
    votes = F.col(votes) if isinstance(votes, str) else votes
    v = values_of(votes)
    spread = F.array_max(v) - F.array_min(v)
    rounded = F.transform(v, lambda x: half_even(x))
    major = _mode(rounded)
    dissent = F.exists(votes, lambda x: F.coalesce((half_even(x["value"]) != major) & (x["confidence"] >= DISSENT), F.lit(False)))
    return (
        F.when(F.exists(votes, lambda x: x["failed"]), "parse_error")
        .when(F.size(v) < 3, "insufficient_valid_votes")
        .when(spread >= RANGE, F.format_string("range_%.1f", half_even(spread, 1)))
        .when((F.size(F.array_distinct(rounded)) > 1) & dissent, "high_confidence_dissent")
        .when(F.size(F.filter(votes, lambda x: x["ambiguous"])) >= 2, "ambiguous_majority")
    )


def first_pass(votes: str | Column = "votes") -> Column:
    """Struct of final_value, method and needs_audit, from the judges alone."""
    v = values_of(votes)
    unanimous = F.size(F.array_distinct(F.transform(v, lambda x: half_even(x)))) == 1
    failed = F.size(v) == 0
    return F.struct(
        F.when(failed, None).when(unanimous, F.get(v, F.lit(0))).otherwise(_mean(v)).alias("final_value"),
        F.when(failed, "failed").when(unanimous, "unanimous").otherwise("mean_small_disagreement").alias("method"),
        failed.alias("needs_audit"),
    )


def adjudicate(values: str | Column) -> Column:
    """Struct of final_value, method and needs_audit, from the adjudicators' values.

    Of values that agree within a half, the mean runs over all agreeing pairs,
    so that a value in two pairs counts twice.
    """
    v = F.filter(F.col(values) if isinstance(values, str) else values, lambda x: x.isNotNull())
    near = F.flatten(F.flatten(F.transform(v, lambda x, i: F.transform(F.filter(F.slice(v, i + 2, F.size(v)), lambda y: F.abs(x - y) <= AGREE), lambda y: F.array(x, y)))))
    n = F.size(v)
    return F.struct(
        F.when(n == 0, None).when(n == 1, F.get(v, F.lit(0))).when(F.size(near) > 0, _mean(near)).otherwise(_mean(v)).alias("final_value"),
        F.when(n == 0, "adjudicator_failed").when(n == 1, "adjudicator_single").when(F.size(near) > 0, "adjudicator_agree").otherwise("adjudicator_disagree_provisional_mean").alias("method"),
        ((n == 0) | ((n > 1) & (F.size(near) == 0))).alias("needs_audit"),
    )


def resolve(votes: DataFrame, adjudications: DataFrame | None, pair: list[str], judge: str = "judge_id") -> DataFrame:
    """One row per pair: final_value, method, needs_audit, adjudicated and adjudication_trigger.

    Pairs with a trigger take the adjudicators' result, ``adjudications`` having
    a row (pair, value) for each; the others that of the first pass.
    """
    gathered = gather(votes, pair, judge).withColumn("adjudication_trigger", trigger())
    if adjudications is None:
        gathered = gathered.withColumn("__panel", F.expr("cast(array() as array<double>)"))
    else:
        panel = adjudications.groupBy(*pair).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(judge).alias("judge"), F.col("value").cast("double").alias("value")))), lambda x: x["value"]).alias("__panel"))
        gathered = gathered.join(panel, pair, "left").withColumn("__panel", F.coalesce("__panel", F.expr("cast(array() as array<double>)")))
    result = F.when(F.col("adjudication_trigger").isNull(), first_pass()).otherwise(adjudicate("__panel"))
    return gathered.withColumn("__r", result).select(*pair, "__r.*", F.col("adjudication_trigger").isNotNull().alias("adjudicated"), "adjudication_trigger")


def verify(resolutions: DataFrame, answers: DataFrame, pair: list[str], threshold: float = 1.0) -> DataFrame:
    """Positive verification of resolved pairs, merged into their final values.

    Only candidates count. ``answers`` has one row per pair at most, with
    verified_value null where no answer could be read. A retained pair takes the
    verified value, a rejected one 0.0; without an answer the value stays and
    the pair is to be audited.
    """
    joined = resolutions.join(answers.select(*pair, "verified_value"), pair, "left")
    candidate = routing("final_value", threshold) == "candidate"
    status = F.when(~candidate, "not_candidate").when(F.col("verified_value").isNull(), "parse_error").when(F.col("verified_value") >= threshold, "retained").otherwise("rejected")
    return joined.withColumn("verification_status", status).withColumns({
        "pre_verification_value": F.col("final_value"),
        "verified_value": F.when(candidate, F.col("verified_value")),
        "final_value": F.when(F.col("verification_status") == "retained", F.col("verified_value")).when(F.col("verification_status") == "rejected", 0.0).otherwise(F.col("final_value")),
        "needs_audit": F.col("needs_audit") | (F.col("verification_status") == "parse_error"),
    })
