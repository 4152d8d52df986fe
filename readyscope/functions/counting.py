"""Row counts, on plain rows or on a cube whose rows stand for many (``operators.cube``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How many rows of equipment a row of a cube stands for
CUBE_ROWS = "equipment_rows"


def is_cube(table: DataFrame) -> bool:
    return CUBE_ROWS in table.columns


def row_count(table: DataFrame) -> Column:
    if is_cube(table):
        return F.coalesce(F.sum(CUBE_ROWS), F.lit(0).cast("long"))
    return F.count("*")


def count_where(table: DataFrame, predicate: Column) -> Column:
    """Rows for which the predicate holds; null does not count."""
    if is_cube(table):
        return F.coalesce(F.sum(F.when(predicate, F.col(CUBE_ROWS))), F.lit(0).cast("long"))
    return F.count_if(predicate)
