"""Whole passes, each a single call: generation, labelling, revalidation, expansion, and the geometry report.

A pass gives its tables as DataFrames; the caller writes them with ``sources.tables``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import normalize_word, routing
from lexiloom.operators import derive, matrix, metrics, models, resolve
from lexiloom.plans import jobs
from lexiloom.plans.materialise import materialise


class Generation(NamedTuple):
    log: DataFrame  # what was there, and the rows of this run
    long: DataFrame
    frequencies: DataFrame
    counters: DataFrame
    pending: int  # responses without a valid row


class Labelling(NamedTuple):
    votes: DataFrame
    adjudications: DataFrame
    resolutions: DataFrame


class Revalidation(NamedTuple):
    log: DataFrame
    long: DataFrame
    frequencies: DataFrame
    manifest: dict
    backup: dict | None  # the manifest as it was, where rows were repaired and no backup exists


GROUP = ("prompt_variant", "word_normalized")


def derived(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The long table and the frequencies of a log: of its last valid rows."""
    valid = derive.latest_valid(log, ["response_id"], "ingest_seq")
    return derive.explode_features(valid, keep=[*GROUP, "response_id", "ingest_seq"]), derive.frequencies(valid, list(GROUP))


def run_generation(words: DataFrame, factory: Callable[[], models.Client], variants: Sequence[str], replicates: int, base_seed: int, model: str, temperature: float = 0.8, version: str = "v3", log: DataFrame | None = None, manifest: Mapping | None = None, run_id: int = 1) -> Generation:
    """Plan, resume, ask, validate, try again, log, and derive.

    ``words`` has word. ``log`` is what earlier runs wrote: its valid responses
    are not asked for again. The configuration must agree with ``manifest``.
    """
    done = derive.latest_valid(log, ["response_id"], "ingest_seq") if log is not None else None
    keyed = words.select("word").distinct().withColumn("word_normalized", normalize_word("word"))
    plan = jobs.preflight(keyed, variants, replicates, base_seed, model, temperature, done, manifest, "word_normalized", version)
    plan.count()  # raises before a model is asked
    planned = jobs.generation_jobs(keyed, variants, replicates, base_seed, model, "word_normalized", version)
    open_ = jobs.pending(planned, done, ["response_id"]) if done is not None else planned
    fresh = models.generate_features(open_, factory, run_id, version, "word_normalized").withColumns({"model": F.lit(model), "temperature": F.lit(float(temperature))})
    whole = materialise(log.unionByName(fresh, allowMissingColumns=True) if log is not None else fresh, "log")
    long, frequencies = derived(whole)
    left = jobs.pending(planned, derive.latest_valid(whole, ["response_id"], "ingest_seq"), ["response_id"]).count()
    return Generation(whole, long, frequencies, derive.counters(whole, "prompt_variant", ["response_id"], "ingest_seq"), left)


def run_labelling(pairs: DataFrame, factory: Callable[[], models.Client], votes: DataFrame | None = None, verify: bool = True, positive: float = 1.0, threshold: float = 1.0) -> Labelling:
    """Judge what has no three votes yet, adjudicate what the rules pick, resolve, and verify the positive.

    ``pairs`` has word, feature_id and feature_text, each pair once.
    """
    key = ["word", "feature_id"]
    open_ = jobs.pending(pairs, jobs.completed_pairs(votes, key), key) if votes is not None else pairs
    fresh = models.judge_panel(open_, factory)
    cast = materialise(votes.unionByName(fresh, allowMissingColumns=True) if votes is not None else fresh, "votes")
    triggered = resolve.gather(cast, key).withColumn("__t", resolve.trigger()).where("__t is not null").select(*key)
    panel = materialise(models.adjudicators(pairs.join(triggered, key, "left_semi"), cast, factory), "adjudications")
    resolved = resolve.resolve(cast, panel, key)
    if not verify:
        return Labelling(cast, panel, resolved)
    resolved = materialise(resolved, "resolutions")
    candidates = pairs.join(resolved.where(routing("final_value", positive) == "candidate").select(*key, "final_value"), key)
    answers = models.verifier(candidates, factory, threshold)
    return Labelling(cast, panel, resolve.verify(resolved, answers, key, threshold))


def run_revalidation(log: DataFrame, manifest: Mapping, at: str, has_backup: bool = False, run_id: int | None = None) -> Revalidation:
    """Parse the raw texts of failed responses again; append, derive, and count, without asking a model.

    ``at`` is the time that the manifest's history gets. Nothing is changed in
    place: the manifest is a new one, and ``backup`` the old one to be written
    beside it the first time that rows are repaired.
    """
    repaired = materialise(derive.revalidate(log, ["response_id"], "ingest_seq"), "repaired")
    whole = materialise(log.unionByName(repaired), "log")
    last = derive.latest(whole, ["response_id"], "ingest_seq")
    failed = F.coalesce("parse_error", F.lit("")) != ""
    before = derive.latest(log, ["response_id"], "ingest_seq").where(failed).count()
    n, unresolved = repaired.count(), last.where(failed).count()
    valid = {r["prompt_variant"]: r["n"] for r in last.where(~failed).groupBy("prompt_variant").agg(F.count("*").alias("n")).collect()}
    long, frequencies = derived(whole)
    new = dict(manifest)
    new["revalidation_history"] = [*manifest.get("revalidation_history", []), {"revalidated_at": at, "candidate_errors": before, "repaired_responses": n, "unresolved_responses": unresolved, "method": "raw texts parsed again; no model calls"}]
    new |= {"valid_responses_total": sum(valid.values()), "valid_responses_by_prompt": valid, "parse_errors_total": unresolved, "generated_feature_tokens_total": long.count(), "revalidated_at": at, "revalidated_responses_total": sum(h["repaired_responses"] for h in new["revalidation_history"])}
    if "total_planned_responses" in new:
        new["pending_after_run"] = int(new["total_planned_responses"]) - new["valid_responses_total"]
    return Revalidation(whole, long, frequencies, new, dict(manifest) if n and not has_backup else None)


def run_expansion(original: DataFrame, item: str, items: DataFrame, resolutions: DataFrame, votes: DataFrame | None = None, plurals: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """The expanded matrix: the original rows, and a row of resolved values for each item that they lack.

    ``original`` is wide, its features being all columns but ``item``, in their
    order; ``resolutions`` has word_normalized, feature_id and final_value, and
    what ``matrix.rollup`` reads. Items without a resolution have zeros.
    """
    features = [c for c in original.columns if c != item]
    old = original.withColumns({"word": F.col(item), "word_original": F.col(item), "word_normalized": normalize_word(item)}).drop(*({item} - {"word"}))
    added = matrix.new_items(items, old.select("word_normalized"), plurals).select("word", F.col("word").alias("word_original"), "word_normalized")
    mine = resolutions.join(added.select("word_normalized"), "word_normalized", "left_semi")
    wide = matrix.pivot(mine, "word_normalized", range(len(features)), value="final_value").withColumnsRenamed({str(i): f for i, f in enumerate(features)})
    totals = matrix.rollup(mine, votes, strict)
    zeros = {f: F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) for f in features} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_positive_features", "n_adjudicated", "n_low_confidence", "n_ambiguous")}
    new = added.join(wide, "word_normalized", "left").join(totals, "word_normalized", "left").withColumns(zeros | {"needs_human_audit": F.coalesce("needs_human_audit", F.lit(False)), "mean_feature_confidence": F.coalesce("mean_feature_confidence", F.lit(0.0))})
    return matrix.expand(old, new)


def geometry(vectors: DataFrame, item: str, category: str | None = None, gold: str = "gold", pred: str = "pred", k: int = 5) -> DataFrame:
    """One row: how far the geometry of two sets of vectors of the same items agrees.

    Mean and median cosine of an item's two vectors; Pearson and Spearman between
    the two matrices of pairwise similarities; mean overlap of nearest
    neighbours; mean similarity within and between categories for either set, if
    ``category`` is given and there are four items and two categories of two or
    more; the mean number of positive features; Pearson and Spearman between the
    features' means.
    """
    rows = materialise(vectors.select(F.col(item).alias("item"), F.col(category).cast("string").alias("category") if category else F.lit(None).cast("string").alias("category"), F.col(gold).cast("array<double>").alias("gold"), F.col(pred).cast("array<double>").alias("pred")), "geometry")
    each = metrics.cosines(rows)
    out = each.agg(F.count("*").alias("n_items"), F.avg("cosine").alias("mean_cosine"), F.avg("n_gold").alias("gold_density"), F.avg("n_pred").alias("pred_density"))
    out = out.crossJoin(metrics.median(each, "cosine").withColumnRenamed("median", "median_cosine"))
    out = out.crossJoin(metrics.pairwise_pearson(rows)).crossJoin(metrics.pairwise_spearman(rows, "item"))
    overlap = metrics.neighbour_jaccard(rows.select("item", F.col("gold").alias("v")), rows.select("item", F.col("pred").alias("v")), "item", "v", k)
    out = out.crossJoin(overlap.agg(F.avg("jaccard").alias("mean_nn_jaccard")))
    cells = rows.select(F.posexplode(F.arrays_zip("gold", "pred")).alias("feature_id", "c")).select("feature_id", "c.gold", "c.pred")
    out = out.crossJoin(metrics.prevalence(cells).select(F.col("pearson").alias("prevalence_pearson"), F.col("spearman").alias("prevalence_spearman")))
    for side in ("gold", "pred"):
        found = metrics.category_separation(metrics.category_similarity(rows, "category", side))
        shown = [F.col(c).alias(f"{side}_{c}") for c in ("within_similarity", "between_similarity", "separation")]
        out = out.crossJoin(found.select(*(shown if category else [F.lit(None).cast("double").alias(f"{side}_{c}") for c in ("within_similarity", "between_similarity", "separation")])))
    return out


class Holdout(NamedTuple):
    labelling: Labelling
    cells: DataFrame  # word_normalized, feature_id, gold, pred
    report: DataFrame  # one row of scores


def _scored(cells: DataFrame, found: Labelling) -> DataFrame:
    """Gold cells (word_normalized, feature_id, value) with the resolved value of their pair; pairs that failed are left out."""
    answers = found.resolutions.select(F.col("word").alias("word_normalized"), "feature_id", F.col("final_value").alias("pred"), *[c for c in ("pre_verification_value", "verification_status") if c in found.resolutions.columns])
    gold = cells.select("word_normalized", "feature_id", F.coalesce("value", F.lit(0.0)).alias("gold"))
    return materialise(gold.join(answers, ["word_normalized", "feature_id"]).where("pred is not null"), "scored")


def _pairs(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("word_normalized").alias("word"), "feature_id", "feature_text").dropDuplicates(["word", "feature_id"])


def holdout_cells(matrix_cells: DataFrame, factory: Callable[[], models.Client], fraction: float = 0.2, seed: str = "cells", verify: bool = True) -> Holdout:
    """Label a part of the cells of a matrix (sources.tables.read_matrix), positive and zero ones apart, and score it.

    The report has the confusion of all cells, ROC-AUC and average precision.
    """
    key = F.concat_ws("|", "word_normalized", F.col("feature_id").cast("string"))
    stratum = F.when(F.col("value") > 0, "positive").otherwise("zero")
    picked = materialise(jobs.stratified_split(matrix_cells.withColumn("__key", key), "__key", stratum, fraction, seed).where("is_test").drop("__key", "stratum", "is_test"), "holdout")
    found = run_labelling(_pairs(picked), factory, verify=verify)
    cells = _scored(picked, found)
    report = metrics.confusion(cells).crossJoin(metrics.roc_auc(cells, score="pred").select("roc_auc")).crossJoin(metrics.average_precision(cells, score="pred").select("average_precision"))
    return Holdout(found, cells, report)


def holdout_words(matrix_cells: DataFrame, categories: DataFrame | None, factory: Callable[[], models.Client], fraction: float = 0.2, seed: str = "words", verify: bool = True) -> Holdout:
    """Label all cells of a part of the words of a matrix, by category (word_normalized, category), and compare the geometry."""
    words = matrix_cells.select("word_normalized").distinct()
    named = words.join(categories.groupBy("word_normalized").agg(F.min("category").alias("category")), "word_normalized", "left") if categories is not None else words.withColumn("category", F.lit(None).cast("string"))
    picked = materialise(jobs.stratified_split(named, "word_normalized", F.coalesce("category", F.lit("unknown")), fraction, seed).where("is_test").select("word_normalized", "category"), "holdout")
    cells = matrix_cells.join(picked.select("word_normalized"), "word_normalized", "left_semi")
    found = run_labelling(_pairs(cells), factory, verify=verify)
    scored = _scored(cells, found)
    n = matrix_cells.agg(F.coalesce(F.max("feature_id"), F.lit(-1)) + 1).first()[0]
    side = lambda value: matrix.vectors(scored, "word_normalized", n, value=value).withColumnRenamed("vector", value)
    vectors = side("gold").join(side("pred"), "word_normalized").join(picked, "word_normalized")
    return Holdout(found, scored, geometry(vectors, "word_normalized", "category" if categories is not None else None))
