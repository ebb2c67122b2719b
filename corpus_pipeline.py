"""The corpus pipeline: documents in known languages, without toxic ones, one of each group of near copies, packed.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``. An empty table
passes through every stage as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import language_id, packing, queries, simhash, toxicity
from lexiloom.llm._shared import fold_of
from lexiloom.plans.materialise import materialise


def filtered(docs: DataFrame, found, condition: str) -> DataFrame:
    """The rows of ``docs`` that ``found``, an operator of (docs, text, keep), gives the condition, whatever their columns are called."""
    names = tuple(f"c{i}" for i in range(len(docs.columns)))
    rows = found(docs.toDF(*names), names[docs.columns.index("text")], names)
    return rows.where(condition).select(*names).toDF(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID does not reject."""
    model = language_id.fit(docs.where(fold_of() != 0))
    return filtered(docs, lambda df, text, keep: language_id.identify(df, model, text, keep), "not rejected")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic."""
    model = queries.toxic_field(spark, sf_dir, docs)
    return filtered(docs, lambda df, text, keep: toxicity.score(df, model, text, keep), "predicted = 0")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group whose sets of five-word shingles are at least 0.8 alike."""
    return simhash.deduplicate(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, every window in the sources' proportions."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", known_language), ("toxicity", not_toxic), ("simhash_dedup", one_of_each), ("packing", packed)]

#: Trained models decide in two stages, which SQL cannot express; the tests hold the pipeline against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
