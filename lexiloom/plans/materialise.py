"""Cutting lineage through tables in the cluster's shared folder.

Intermediate results that are read more than once, or that must outlive a lost
executor, are written as Parquet below ``spark.checkpoint.dir`` and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session of one machine that names no shared folder.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("a cluster's session must name the folder that its machines share in spark.checkpoint.dir")
    return (named or LOCAL_DIR).rstrip("/")


#: Paths that this driver has made and not deleted.
MADE: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/lexiloom-{tag}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    if path in MADE:
        MADE.remove(path)


def materialise(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that scans the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that ``materialise`` returned."""
    path = getattr(df, "_lexiloom_path", None)
    if path is None:
        return
    _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete all that this driver has made, once the results that read it have been consumed."""
    for path in [*MADE]:
        _delete(spark, path)
