"""A stored count cube: one scan of the fleet for all reports and KPIs.

A row of the cube is a combination of the columns that reports group by or filter on,
with the number of equipment rows that have it. It has as many rows as there are such
combinations, however large the fleet. Every KPI and every report takes a cube in place of
the equipment table and gives the same result: they sum what they would have counted.
Lists of single units (the action list) need the equipment itself.

Cubes are stored by month and published whole (``sources.reports``). Months that hold
different equipment, such as what was installed in each, are merged by adding up counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readyscope.functions.counting import CUBE_ROWS, row_count
from readyscope.model import (
    BUSINESS_LINE,
    CITY,
    LEVEL,
    LINK_STATUS,
    REGION,
    STATE,
    SYSTEM_ID,
    SYSTEM_NAME,
)
from readyscope.sources.reports import MONTH_COLUMN, export_month, published_months, read_months

CUBE_COLUMNS = [SYSTEM_ID, SYSTEM_NAME, BUSINESS_LINE, CITY, STATE, REGION, LEVEL, LINK_STATUS]


def count_cube(equipment: DataFrame, columns: Sequence[str] = CUBE_COLUMNS) -> DataFrame:
    """The counts of equipment, or of another cube, by those of the columns that it has.

    Shuffles partial counts. Null is a value like any other.
    """
    present = [c for c in columns if c in equipment.columns]
    return equipment.groupBy(*present).agg(row_count(equipment).alias(CUBE_ROWS))


def store_cube(equipment: DataFrame, base_path: str, month: str) -> str:
    """Count a month's equipment and publish its cube, replacing an earlier one."""
    return export_month(count_cube(equipment), base_path, month, rebalance=True)


def read_cube(spark: SparkSession, base_path: str, months: Iterable[str] | None = None) -> DataFrame:
    """The cube of some months, or of all, with equal combinations added up.

    Where a single month is read, it is the stored table itself.
    """
    stored = read_months(spark, base_path)
    wanted = list(published_months(spark, base_path) if months is None else months)
    chosen = stored.where(F.col(MONTH_COLUMN).isin(wanted)).drop(MONTH_COLUMN)
    return chosen if len(wanted) == 1 else count_cube(chosen, [c for c in chosen.columns if c != CUBE_ROWS])
