"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_directory(spark: SparkSession, purpose: str) -> str:
    """A new directory for one purpose, below one folder per application.

    It lies in the folder that ``spark.checkpoint.dir`` names, or in the warehouse
    where that is unset. A machine's own disk is no place that other machines
    see, so a ``file:`` folder is refused unless the master is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    local = spark.conf.get("spark.master", "").startswith("local")
    if not local and base.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/readyscope/{application}/{purpose}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows as Parquet into the shared folder and scan them from there.

    What follows no longer depends on the tasks before: a lost executor costs
    a new read, not a new computation. The schema is known, so none is inferred.
    """
    spark = rows.sparkSession
    path = shared_directory(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove what this application has stored, once no result that reads it is needed."""
    folder = shared_directory(spark, "any").rpartition("/")[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
