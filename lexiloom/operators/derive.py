"""The append-only response log: compaction, explosion, frequencies, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.json_rules import validate_generation
from lexiloom.functions.text import normalize_feature


def _best(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def latest(log: DataFrame, keys: Sequence[str], *seq: str) -> DataFrame:
    """The last row of each key."""
    return _best(log, keys, [F.col(s).desc() for s in seq])


def earliest(rows: DataFrame, keys: Sequence[str], *seq: str) -> DataFrame:
    """The first row of each key."""
    return _best(rows, keys, [F.col(s).asc() for s in seq])


def latest_valid(log: DataFrame, keys: Sequence[str], *seq: str, error: str = "parse_error") -> DataFrame:
    """The last valid row of each key: errors are dropped first, so an older valid row survives a later error."""
    return latest(log.where(F.coalesce(F.col(error), F.lit("")) == ""), keys, *seq)


def explode_features(log: DataFrame, features: str = "features", keep: Sequence[str] = ("response_id",)) -> DataFrame:
    """One row per feature: ``keep``, feature_rank from 1, feature_text and its normalised form."""
    out = log.select(*keep, F.posexplode(features).alias("__i", "feature_text"))
    return out.select(*keep, (F.col("__i") + 1).alias("feature_rank"), "feature_text", normalize_feature("feature_text").alias("feature_text_normalized"))


def frequencies(log: DataFrame, group: Sequence[str], response: str = "response_id", seq: str = "ingest_seq", features: str = "features") -> DataFrame:
    """In how many responses of its group each feature occurs, of how many, and the spelling met first.

    A feature counts once in a response. The log must be compacted and valid.
    """
    totals = log.groupBy(*group).agg(F.count_distinct(response).alias("valid_response_count"))
    each = explode_features(log, features, [*group, response, seq]).groupBy(*group, "feature_text_normalized", response).agg(F.min(F.struct(seq, "feature_rank", "feature_text")).alias("__first"))
    counted = each.groupBy(*group, "feature_text_normalized").agg(F.count("*").alias("response_frequency"), F.min("__first")["feature_text"].alias("feature_text_example"))
    return counted.join(totals, list(group)).withColumn("response_proportion", F.col("response_frequency") / F.col("valid_response_count"))


def counters(log: DataFrame, variant: str, keys: Sequence[str], *seq: str, error: str = "parse_error") -> DataFrame:
    """Rows, keys, valid and failed keys by variant; whether a key is valid is its last row's matter."""
    last = latest(log, keys, *seq).groupBy(variant).agg(F.count("*").alias("responses"), F.count_if(F.coalesce(F.col(error), F.lit("")) == "").alias("valid"))
    rows = log.groupBy(variant).agg(F.count("*").alias("log_rows"))
    return rows.join(last, variant).withColumn("failed", F.col("responses") - F.col("valid"))


def revalidate(log: DataFrame, keys: Sequence[str], *seq: str, word: str = "word") -> DataFrame:
    """Rows to append for responses whose last row is an error but whose raw text now parses.

    Nothing is changed in place; the appended rows carry the next ingest_seq of
    their response, so that they are the last ones.
    """
    failed = latest(log, keys, *seq).where(F.coalesce("parse_error", F.lit("")) != "")
    checked = failed.withColumn("__v", validate_generation(F.col("raw_json"), F.col(word)))
    fixed = {"features": F.col("__v.record.features"), "parse_error": F.lit(""), "ingest_seq": F.col("ingest_seq") + 1}
    if "n_features" in log.columns:
        fixed["n_features"] = F.size("__v.record.features")
    return checked.where("__v.parse_error = ''").withColumns(fixed).drop("__v")
