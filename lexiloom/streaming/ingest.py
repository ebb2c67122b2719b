"""Incremental ingest of response logs: append, compact, derive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.derive import latest


def compacting_sink(table: str, keys: list[str], seq: str):
    """A function for foreachBatch that appends the last row of each key of a batch; the batch's number makes it repeatable."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = latest(batch, keys, seq).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return sink


def ingest(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, keys: list[str], seq: str):
    """Run a file stream over what is new in ``source`` and stop; the started query is returned."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(compacting_sink(table, keys, seq)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, table: str, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key over all batches."""
    return latest(spark.read.parquet(f"{table}/batch=*"), keys, seq)


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window of event time and key; later than ``late`` is left out. Times without a zone are the session's, and come back as such."""
    kind = stream.schema[ts].dataType.simpleString()
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n_rows")).select(F.col("window.start").cast(kind).alias("window_start"), by, "n_rows")


def run_windowed_counts(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, ts: str, by: str, files: int = 1) -> DataFrame:
    """``windowed_counts`` over a folder as a stream, ``files`` a step, until what is there has been read; the counts of all windows.

    Every step replaces the table by all counts so far, so a step that runs again changes nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(source)
    counted = windowed_counts(stream, ts, by)
    sink = lambda batch, number: batch.write.mode("overwrite").parquet(table)
    counted.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counted.schema).parquet(table)
