"""Equipment and targets derived from the retail star tables.

One equipment row per line item. The order, customer and part of a line are
looked up by primary key with left joins, so a lookup never adds or drops rows,
and one whose columns are not asked for is left out of the plan.

No join carries a hint. Spark broadcasts a table only when its own size check
passes, which the region and nation lists always do; the growing tables are
shuffled beyond that, where AQE splits hot keys and merges small partitions
only up to ``SHUFFLE_BYTES``. The number of partitions grows with the lines, by
``LINE_BYTES``, so that no partition does.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readyscope.model import (
    BUSINESS_LINE,
    CITY,
    CONNECTED_NOT_READY,
    EQUIPMENT_COLUMNS,
    INSTALLED_ON,
    LEVEL,
    LINK_OK,
    LINK_STATUS,
    MATERIAL_ID,
    MOBILITY,
    NOT_CONNECTED,
    READY,
    REGION,
    SERIAL,
    STATE,
    SYSTEM_ID,
    SYSTEM_NAME,
    TARGET,
)
from readyscope.session import MANY_PARTITIONS

# Compressed bytes of a merged shuffle partition. The lines of an order shuffle in few bytes;
# a task that sorts them for a join holds about twenty times as many.
SHUFFLE_BYTES = 16 * 1024 * 1024
# Bytes of the lines' files for one shuffle partition at most
LINE_BYTES = 4 * 1024 * 1024

# "Middle East" plays the region with a short label
RETAIL_REGION_LABELS = {"MIDDLE EAST": "ME"}

# The columns read here; declared, so that no job runs just to infer them
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string",
    "part": "p_partkey bigint, p_name string, p_type string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int,"
    " l_returnflag string, l_shipdate timestamp_ntz",
}

# Which table a column comes from; all others come from the line itself
_PART_COLUMNS = {SYSTEM_NAME}
_REGION_COLUMNS = {REGION, STATE}
_NATION_COLUMNS = {CITY} | _REGION_COLUMNS
_CUSTOMER_COLUMNS = {BUSINESS_LINE} | _NATION_COLUMNS
_ORDER_COLUMNS = {LEVEL} | _CUSTOMER_COLUMNS


def _system_id() -> Column:
    """The part of a line; every seventh line of an order is of a model that no part is."""
    part = F.col("l_partkey")
    return F.when(F.col("l_linenumber") == 7, -part - 1).otherwise(part)


def _expressions() -> dict[str, Column]:
    return {
        SERIAL: F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        LEVEL: F.when(F.col("o_orderstatus") == "F", READY)
        .when(F.col("o_orderstatus") == "P", CONNECTED_NOT_READY)
        .otherwise(NOT_CONNECTED),
        SYSTEM_ID: _system_id(),
        SYSTEM_NAME: F.col("p_name"),
        BUSINESS_LINE: F.col("c_mktsegment"),
        CITY: F.col("n_name"),
        STATE: F.substring("r_name", 1, 2),
        REGION: F.col("r_name"),
        LINK_STATUS: F.when(F.col("l_returnflag") == "N", LINK_OK).when(
            F.col("l_returnflag") == "A", "Connection Expired 30+ days"
        ),
        INSTALLED_ON: F.col("l_shipdate").cast("date"),
    }


def equipment(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = EQUIPMENT_COLUMNS
) -> DataFrame:
    """The given equipment columns, from as few tables as they need."""

    def table(name: str) -> DataFrame:
        return _table(spark, sf_dir, name)

    _merge_less(spark)
    _divide_more(spark, f"{sf_dir}/lineitem.parquet")
    wanted = set(columns)
    rows = table("lineitem")
    if wanted & _ORDER_COLUMNS:
        # order-level lookups first: there are fewer orders than lines
        orders = table("orders")
        if wanted & _CUSTOMER_COLUMNS:
            customers = table("customer")
            if wanted & _NATION_COLUMNS:
                nations = table("nation")
                if wanted & _REGION_COLUMNS:
                    nations = _lookup(nations, "n_regionkey", table("region"), "r_regionkey")
                customers = _lookup(customers, "c_nationkey", nations, "n_nationkey")
            orders = _lookup(orders, "o_custkey", customers, "c_custkey")
        rows = _lookup(rows, "l_orderkey", orders, "o_orderkey")
    if wanted & _PART_COLUMNS:
        # last, so that filters on the order cut the lines before they meet the parts
        part = table("part")
        rows = rows.join(part, _system_id() == part["p_partkey"], "left")
    expressions = _expressions()
    return rows.select(*[expressions[name].alias(name) for name in columns])


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each system."""
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(SYSTEM_ID), F.col("p_name").alias(SYSTEM_NAME)
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target per part. Equipment of an order's seventh line has none."""
    mobile = F.col("p_type").isin("SMALL", "ECONOMY")
    return (
        _table(spark, sf_dir, "part")
        .select(
            F.col("p_partkey").alias(MATERIAL_ID),
            F.col("p_name").alias(SYSTEM_NAME),
            F.when(mobile, "MOBILE SYSTEM").otherwise("FIXED SYSTEM").alias(MOBILITY),
            F.when(mobile, 0.25).otherwise(0.87).alias(TARGET),
        )
    )


def _merge_less(spark: SparkSession) -> None:
    """Merge shuffle partitions up to ``SHUFFLE_BYTES`` at most. A session that already asks
    for less keeps that. No result depends on it.
    """
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > SHUFFLE_BYTES:
        spark.conf.set(key, str(SHUFFLE_BYTES))


def _divide_more(spark: SparkSession, lines: str) -> None:
    """A shuffle partition for every ``LINE_BYTES`` of the lines, where the session has fewer;
    from ``MANY_PARTITIONS`` on, their size grows. No result depends on it.
    """
    key = "spark.sql.shuffle.partitions"
    path = spark._jvm.org.apache.hadoop.fs.Path(lines)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    partitions = min(math.ceil(size / LINE_BYTES), MANY_PARTITIONS)
    if partitions > int(spark.conf.get(key)):
        spark.conf.set(key, str(partitions))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    return rows.join(table, rows[key] == table[table_key], "left")
