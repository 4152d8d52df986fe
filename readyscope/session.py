"""Session settings for cluster jobs, and a local session for tests and benchmarks."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

ADVISORY_PARTITION_BYTES = 64 * 1024 * 1024
SCAN_PARTITION_BYTES = 128 * 1024 * 1024

# Every map task writes a block per partition. From this many partitions on, their size
# grows with the data instead of their number.
MANY_PARTITIONS = 40_000


def partition_bytes_for(shuffle_bytes: int, many: int = MANY_PARTITIONS) -> int:
    """The size of a shuffle partition: the advisory size, or more where that would make
    more than ``many`` of them."""
    return max(ADVISORY_PARTITION_BYTES, math.ceil(shuffle_bytes / many))


def shuffle_partitions_for(shuffle_bytes: int, cores: int, many: int = MANY_PARTITIONS) -> int:
    """Partitions of that size, never fewer than the cores.

    AQE merges partitions that turn out small, so an over-estimate of
    ``shuffle_bytes`` costs little.
    """
    return max(cores, math.ceil(shuffle_bytes / partition_bytes_for(shuffle_bytes, many)))


def recommended_conf(
    shuffle_bytes: int, cores: int, many: int = MANY_PARTITIONS
) -> dict[str, str]:
    """SQL settings for a job that shuffles about ``shuffle_bytes``."""
    advisory = str(partition_bytes_for(shuffle_bytes, many))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even where the split costs one more shuffle
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # hash instead of sort where every build partition is measured this small
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(ADVISORY_PARTITION_BYTES),
        "spark.sql.shuffle.partitions": str(shuffle_partitions_for(shuffle_bytes, cores, many)),
        "spark.sql.files.maxPartitionBytes": str(SCAN_PARTITION_BYTES),
        "spark.sql.session.timeZone": "UTC",
    }


def local_session(cores: int = 8, scratch: str | None = None) -> SparkSession:
    """One-JVM session without the web page.

    ``scratch`` becomes the shared folder where the installation names none.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("readyscope")
    for key, value in recommended_conf(shuffle_bytes=0, cores=cores).items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # call sites in error messages cost plan-building time on every column
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    if scratch and not spark.conf.get("spark.checkpoint.dir", None):
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", scratch).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
