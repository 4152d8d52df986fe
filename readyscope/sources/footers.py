"""The rows of a stored table from the footers of its files.

A Parquet file keeps how many rows it has. Spark reads that instead of a column if an
aggregate asks for nothing else, has no filter but on partitions, and the reader may push
it down. Values, nulls and extremes of columns are not asked for: Spark counts them wrong
where a file is empty, and fails where a file has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings, whose Parquet reader takes aggregates."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    first_version = own.conf.get("spark.sql.sources.useV1SourceList").split(",")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(s for s in first_version if s != "parquet"))
    return own


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """``total_equipment``: the rows of a Parquet table, without reading a column."""
    counted = _session(spark).read.parquet(path).agg(F.count("*").alias("n"))
    # An empty table has no footer that counts anything. A count is taken to be never null,
    # so a plain coalesce would be dropped.
    n = F.coalesce(F.nullif(F.col("n"), F.lit(-1)), F.lit(0))
    return counted.select(n.cast("long").alias("total_equipment"))
