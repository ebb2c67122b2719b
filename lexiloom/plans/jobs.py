"""Planning: subsets, job lists, resume, splits, drift and preflight."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.prompts import generation_system, generation_user, load
from lexiloom.functions.text import prompt_hash, response_id, sampling_seed
from lexiloom.plans.running import numbered


class DriftError(ValueError):
    """A stored manifest differs from the present configuration."""


def even_subset(df: DataFrame, k: int, *order: str) -> DataFrame:
    """``k`` rows at even distances in ``order``: positions i * (n - 1) / (k - 1), halves to the even one.

    One row is the first; k of n or more is all rows; k under one is an error.
    """
    if k < 1:
        raise ValueError("a subset needs at least one row")
    rows = numbered(df, *[F.col(c) for c in order])
    n = df.count()
    if k >= n:
        return rows.drop("row_index")
    picks = df.sparkSession.range(k).select(F.bround(F.col("id") * (n - 1) / max(1, k - 1), 0).cast("long").alias("row_index"))
    return rows.join(F.broadcast(picks.distinct()), "row_index", "left_semi").drop("row_index")


def generation_jobs(words: DataFrame, variants: Sequence[str], replicates: int, base_seed: int, model: str, word: str = "word", version: str = "v3") -> DataFrame:
    """Word x variant x replicate, with paired seeds and response ids. Variants and replicates are exploded, not joined.

    The prompt's hash is of the messages as they are sent, so ids change when a prompt does.
    """
    for variant in variants:
        load("generation", version, variant)
    jobs = words.withColumn("prompt_variant", F.explode(F.array(*map(F.lit, variants)))).withColumn("replicate_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    jobs = jobs.withColumn("sampling_seed", sampling_seed(base_seed, word, "replicate_id"))
    return jobs.withColumn("prompt_hash", prompt_hash(generation_system("prompt_variant", version), generation_user(word))).withColumn("response_id", response_id(word, "prompt_variant", "replicate_id", F.lit(model), "sampling_seed", "prompt_hash"))


def labelling_jobs(words: DataFrame, features: DataFrame, most_features: int = 100_000) -> DataFrame:
    """Every word with every feature. The features are the columns of a matrix; their number is checked before they are broadcast."""
    n = features.count()
    if n > most_features:
        raise ValueError(f"{n} features are more than the {most_features} that may be broadcast")
    return words.crossJoin(F.broadcast(features))


def completed_pairs(votes: DataFrame, pair: Sequence[str], least: int = 3, judge: str = "judge_id") -> DataFrame:
    """Pairs with at least ``least`` votes; unreadable votes count."""
    return votes.groupBy(*pair).agg(F.count(judge).alias("__n")).where(F.col("__n") >= least).select(*pair)


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return jobs.join(done.select(*keys), list(keys), "left_anti")


def stratified_split(df: DataFrame, key: str, stratum: Column, fraction: float, seed: str, least: int = 1) -> DataFrame:
    """Adds stratum and is_test: of each stratum, max(least, n * fraction rounded half to even) rows in hash order.

    Keys must be unique; one null key may be among them. Large strata are not
    sorted in one task: rows get their position within a stratum by blocks of
    the hash, 65,536 a stratum at most, whose counts add up.
    """
    name = F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit(""))
    rows = df.withColumn("stratum", stratum).withColumn("__h", F.sha2(F.concat(F.lit(seed), name), 256)).withColumn("__block", F.substring("__h", 1, 4))
    sums = rows.groupBy("stratum", "__block").agg(F.count("*").alias("__n"))
    by = W.partitionBy("stratum")
    blocks = sums.select("stratum", "__block", F.coalesce(F.sum("__n").over(by.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__n").over(by).alias("__all"))
    placed = rows.withColumn("__i", F.row_number().over(W.partitionBy("stratum", "__block").orderBy("__h", key)))
    take = F.greatest(F.lit(least), F.bround(F.col("__all") * fraction, 0).cast("long"))
    out = placed.join(blocks, (placed["stratum"].eqNullSafe(blocks["stratum"])) & (placed["__block"] == blocks["__block"])).drop(blocks["stratum"]).drop(blocks["__block"])
    return out.withColumn("is_test", F.col("__start") + F.col("__i") <= take).drop("__h", "__block", "__start", "__all", "__i")


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def check_drift(config: Mapping, manifest: Mapping | None) -> None:
    """Every key of the configuration must be the same in the stored manifest; keys only there do not matter."""
    changed = {k: (manifest.get(k), v) for k, v in config.items() if manifest.get(k) != v} if manifest else {}
    if changed:
        raise DriftError("; ".join(f"{k}: stored {a!r}, now {b!r}" for k, (a, b) in sorted(changed.items())))


def preflight(words: DataFrame, variants: Sequence[str], replicates: int, base_seed: int, model: str, temperature: float, done: DataFrame | None = None, manifest: Mapping | None = None, word: str = "word", version: str = "v3") -> DataFrame:
    """Counts of a generation plan, one row, without calling a model.

    Several replicates need a temperature over zero; a manifest must not have
    drifted; two jobs of one word and variant must not share a seed.
    """
    if temperature <= 0 and replicates > 1:
        raise ValueError("replicates at temperature zero would all be the same")
    check_drift({"model": model, "base_seed": base_seed, "variants": list(variants), "replicates": replicates}, manifest)
    jobs = generation_jobs(words, variants, replicates, base_seed, model, word, version)
    open_ = pending(jobs, done, ["response_id"]) if done is not None else jobs
    clash = jobs.groupBy(word, "prompt_variant", "sampling_seed").count().where("count > 1").agg(F.count("*").alias("seed_collisions"))
    return jobs.agg(F.count("*").alias("jobs"), F.count_distinct(word).alias("words")).crossJoin(open_.agg(F.count("*").alias("pending"))).crossJoin(clash)
