"""Sources and sinks: matrices, items, logs, manifests."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.text import normalize_word
from lexiloom.operators.matrix import unpivot
from lexiloom.plans.materialise import materialise

POINTER = "version https://git-lfs.github.com/spec"
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
LOG = logging.getLogger("lexiloom")
MOST_FILES = 100_000

LOG_SCHEMA = (
    "job_id string, response_id string, word_original string, word_normalized string, prompt_variant string, replicate_id int, model string, temperature double, "
    "sampling_seed long, features_json string, n_features int, raw_json string, parse_error string, prompt_hash string, finish_reason string, prompt_tokens int, completion_tokens int"
)


def first_line(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0] if rows else ""


def guard_pointer(spark: SparkSession, path: str) -> None:
    """A file that only points to large-file storage is an error, not data."""
    if first_line(spark, path).startswith(POINTER):
        raise ValueError(f"{path} is a pointer to large-file storage; fetch the file itself")


def in_file_order(df: DataFrame, out: str) -> DataFrame:
    """Rows of files that are read whole (with file_path), numbered by the files' names and then by their place in the file.

    A file lies in one partition, within which Spark's row numbers grow with the
    place; only the files' names, one row a file, meet in one task. They are
    broadcast if they are few, as a large file's rows would otherwise meet.
    """
    rows = df.withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    files = rows.select("file_path").distinct().withColumn("__file", F.row_number().over(W.orderBy("file_path")) - 1)
    files = F.broadcast(files) if len(df.inputFiles()) <= MOST_FILES else files
    return rows.join(files, "file_path").withColumn(out, F.shiftleft(F.col("__file").cast("long"), 40) + F.col("__row")).drop("file_path", "__row", "__file")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, all_strings: bool = False) -> DataFrame:
    """A CSV file with quoted line breaks; only empty fields are null, and with ``all_strings`` not even those."""
    guard_pointer(spark, path)
    reader = spark.read.options(**CSV)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]) if all_strings else df


def read_matrix(spark: SparkSession, path: str, item: str | None = None) -> DataFrame:
    """(word_normalized, feature_id, feature_text, value) of a wide matrix; the first column is the item unless named."""
    wide = read_csv(spark, path)
    if item is not None and item not in wide.columns:
        raise ValueError(f"the matrix has no column {item}")
    item = item or wide.columns[0]
    long = unpivot(wide, item, [c for c in wide.columns if c != item])
    return long.select(normalize_word(F.col(item)).alias("word_normalized"), "feature_id", "feature_text", "value")


def feature_schema(spark: SparkSession, path: str, item: str | None = None) -> DataFrame:
    """(feature_id, feature_text) from the header alone."""
    columns = read_csv(spark, path).limit(0).columns
    item = item or columns[0]
    if item not in columns:
        raise ValueError(f"the matrix has no column {item}")
    return spark.createDataFrame([*enumerate(c for c in columns if c != item)], "feature_id int, feature_text string")


def read_items(spark: SparkSession, path: str, column: str = "word") -> DataFrame:
    """(word, input_seq): the named column, or else the first; nulls dropped, repetitions kept, in the file's order."""
    df = read_csv(spark, path)
    name = column if column in df.columns else df.columns[0]
    return in_file_order(df.select(F.col(f"`{name}`").alias("word"), "_metadata.file_path"), "input_seq").where("word is not null")


def read_plurals(spark: SparkSession, path: str, singular: str = "singular", plural: str = "plural") -> DataFrame:
    """(singular, plural, seq), in the file's order; of equal singulars the last one counts."""
    df = read_csv(spark, path)
    if missing := [c for c in (singular, plural) if c not in df.columns]:
        raise ValueError(f"the plurals have no column {missing[0]}")
    return in_file_order(df.select(F.col(singular).alias("singular"), F.col(plural).alias("plural"), "_metadata.file_path"), "seq").where("singular is not null and plural is not null")


def read_categories(spark: SparkSession, path: str, name: str = "Name", category: str = "Category") -> DataFrame:
    df = read_csv(spark, path)
    if missing := [c for c in (name, category) if c not in df.columns]:
        raise ValueError(f"the categories have no column {missing[0]}")
    return df.select(F.col(name).alias("word"), normalize_word(name).alias("word_normalized"), F.col(category).alias("category"))


def read_generation_log(spark: SparkSession, path: str) -> DataFrame:
    """A response log with features as an array and nulls as empty texts; ingest_seq follows the files' names and the rows' order in them."""
    df = read_csv(spark, path, schema=LOG_SCHEMA)
    ordered = in_file_order(df.select("*", "_metadata.file_path"), "ingest_seq")
    texts = {c: F.coalesce(c, F.lit("")) for c, kind in df.dtypes if kind == "string"}
    return ordered.withColumns(texts).withColumn("features", F.coalesce(F.from_json("features_json", "array<string>"), F.expr("cast(array() as array<string>)")))


def read_text(spark: SparkSession, path: str) -> str:
    """One small text file, stripped."""
    return spark.read.text(path, wholetext=True).first()[0].strip()


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


RUN_BITS = 40  # rows of a run


def in_run_order(df: DataFrame, run_id: int) -> DataFrame:
    """Adds run_id and ingest_seq: the run's number, then the row's number within the run, each once.

    Rows are written first, so that a task that runs again numbers them alike;
    partitions count on from one another by their counts, one row a partition.
    """
    if not 0 <= run_id < 1 << (63 - RUN_BITS):
        raise ValueError("a run's number is out of range")
    rows = materialise(df.withColumn("__row", F.monotonically_increasing_id()), "run").withColumn("__part", F.shiftright("__row", 33))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    number = F.lit(run_id << RUN_BITS).cast("long") + F.col("__start") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(starts, "__part").withColumns({"run_id": F.lit(run_id).cast("long"), "ingest_seq": number}).drop("__row", "__part", "__start")


def append_log(df: DataFrame, path: str, run_id: int) -> None:
    """Append a run to a log, in an order that is explicit."""
    in_run_order(df.drop("run_id", "ingest_seq"), run_id).write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", resume: bool = True) -> None:
    """Replace a table (parquet, csv or json). Without ``resume``, an existing one is an error."""
    writer = df.write.mode("overwrite" if resume else "errorifexists")
    if kind == "csv":
        writer = writer.options(header="true", quote='"', escape='"')
    writer.format(kind).save(path)
    LOG.info("wrote %s", path)


def write_ordered(df: DataFrame, path: str, *order: str, kind: str = "csv") -> None:
    """Replace a table by ``df`` in ``order``: ranges are sorted side by side, and the files' names follow the ranges."""
    write_table(df.orderBy(*order), path, kind)


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, sha256) of input and schema files, byte by byte; a folder gives all its files."""
    found = spark.read.format("binaryFile").load(list(paths))
    return found.select("path", F.sha2("content", 256).alias("sha256"))
