"""Item-feature matrices: long and wide forms, expansion, occurrences, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import normalize_word, truthy
from lexiloom.operators.derive import earliest


def unpivot(wide: DataFrame, item: str, features: Sequence[str] | None = None) -> DataFrame:
    """(item, feature_id, feature_text, value), ids being positions among the other columns, from 0."""
    features = list(features or [c for c in wide.columns if c != item])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature_id"), F.lit(f).alias("feature_text"), F.col(f"`{f}`").cast("double").alias("value")) for i, f in enumerate(features)]))
    return wide.select(item, cells.alias("__c")).select(item, "__c.*")


def pivot(cells: DataFrame, item: str, features: Sequence, feature: str = "feature_id", value: str = "value", seq: str | None = None) -> DataFrame:
    """One column per feature, 0.0 where there is no cell; of several, the last that is not null (without ``seq``, the largest)."""
    def last(f: object) -> Column:
        mine = F.when((F.col(feature) == F.lit(f)) & F.col(value).isNotNull(), F.col(value))
        best = F.max_by(mine, F.when(mine.isNotNull(), F.col(seq))) if seq else F.max(mine)
        return F.coalesce(best, F.lit(0.0)).alias(str(f))

    return cells.groupBy(item).agg(*[last(f) for f in features])


def vectors(cells: DataFrame, item: str, n: int, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """(item, vector): the cells as an array by feature id, 0.0 where there is none; ids of ``n`` and over do not count."""
    kept = cells.where((F.col(feature) >= 0) & (F.col(feature) < n) & F.col(value).isNotNull()).groupBy(item, feature).agg(F.max(value).alias("__v"))
    gathered = kept.groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct(feature, "__v"))).alias("__m"))
    return gathered.select(item, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.col("__m")[i], F.lit(0.0))).alias("vector"))


def rollup(resolutions: DataFrame, votes: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Word totals of resolved cells: positive, adjudicated, and whether any cell is to be audited.

    With ``votes``, mean confidence and the numbers of votes that are ambiguous
    or of low confidence; ``strict`` gives zeros for these instead.
    """
    words = resolutions.groupBy("word_normalized").agg(F.count_if(F.col("final_value") > 0).alias("n_positive_features"), F.count_if("adjudicated").alias("n_adjudicated"), F.bool_or("needs_audit").alias("needs_human_audit"))
    if strict or votes is None:
        return words.withColumns({"mean_feature_confidence": F.lit(0.0), "n_low_confidence": F.lit(0).cast("long"), "n_ambiguous": F.lit(0).cast("long")})
    by_votes = votes.groupBy("word_normalized").agg(F.avg("confidence").alias("mean_feature_confidence"), F.count_if(F.col("confidence") < 0.8).alias("n_low_confidence"), F.count_if("ambiguous").alias("n_ambiguous"))
    return words.join(by_votes, "word_normalized", "left")


def new_items(items: DataFrame, existing: DataFrame, plurals: DataFrame | None = None, seq: str = "input_seq") -> DataFrame:
    """Items that the matrix lacks: normalised, taken to the plural where one is known, each once, first spelling kept."""
    keyed = items.withColumn("word_normalized", normalize_word("word"))
    if plurals is not None:
        last = plurals.groupBy(normalize_word("singular").alias("word_normalized")).agg(F.max_by(normalize_word("plural"), F.col("seq")).alias("__plural"))
        keyed = keyed.join(last, "word_normalized", "left").withColumn("word_normalized", F.coalesce("__plural", "word_normalized")).drop("__plural")
    return earliest(keyed.where("word_normalized <> ''"), ["word_normalized"], seq).join(existing.select("word_normalized"), "word_normalized", "left_anti")


def expand(original: DataFrame, added: DataFrame, word: str = "word") -> DataFrame:
    """Original and new rows as one matrix, with their source; original rows keep their word."""
    old = original.withColumns({"source": F.lit("original"), "in_original": F.lit(True), "in_expansion": F.lit(False), "completion_method": F.lit("human")})
    new = added.withColumns({"source": F.lit("expansion"), "in_original": F.lit(False), "in_expansion": F.lit(True), "completion_method": F.lit("model")})
    out = old.unionByName(new, allowMissingColumns=True)
    return out.withColumn(word, F.coalesce(F.col(word), F.col("word_normalized")))


def annotate_occurrences(occurrences: DataFrame, matrix: DataFrame, key: str = "word_key", carried: Sequence[str] = ("source",)) -> DataFrame:
    """Occurrences with their word's columns; a word that the matrix lacks has source 'missing'. Repeated matrix words multiply."""
    joined = occurrences.join(matrix.select("word_normalized", *carried), occurrences[key] == matrix["word_normalized"], "left")
    return joined.withColumn("source", F.coalesce("source", F.lit("missing"))).drop("word_normalized")


def covered(items: DataFrame, matrix: DataFrame, key: str, out: str = "covered") -> DataFrame:
    """Adds whether the key is one of the matrix's words."""
    known = matrix.select(F.col("word_normalized").alias("__known")).distinct()
    return items.join(known, items[key] == known["__known"], "left").withColumn(out, F.col("__known").isNotNull()).drop("__known")


def coverage_summary(flagged: DataFrame, flag: str = "covered") -> DataFrame:
    """n_items, n_covered and coverage_rate (0.0 without items), one row."""
    return flagged.agg(F.count("*").alias("n_items"), F.count_if(flag).alias("n_covered")).withColumn("coverage_rate", F.coalesce(F.try_divide("n_covered", "n_items"), F.lit(0.0)))


def coverage_by(flagged: DataFrame, group: str, flag: str = "covered") -> DataFrame:
    """The same by group, null groups left out, and whether the rate is 1 when rounded to four places."""
    out = flagged.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_items"), F.count_if(flag).alias("n_covered"))
    rate = F.col("n_covered") / F.col("n_items")
    return out.withColumn("coverage_rate", rate).withColumn("is_complete", F.bround(rate, 4) == 1.0)


def lure_coverage(flagged: DataFrame, lure: str, flag: str = "covered") -> DataFrame:
    return coverage_summary(flagged.where(truthy(lure)), flag)
