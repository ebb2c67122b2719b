"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def arrow_batches(spark: SparkSession, rows: int = 2000, bytes_: int = 8 << 20) -> None:
    """Bound what one Arrow batch holds, whatever the length of its texts. A session's smaller bounds stay as they are."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", bytes_)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % 5


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as they are, whatever others the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def beside(keep: tuple[str, ...], name: str = "__text") -> str:
    """A name that is none of ``keep``."""
    while name in keep:
        name += "_"
    return name
