"""Distinct category values for filter lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readyscope.functions.labels import title_label
from readyscope.model import BUSINESS_LINE, LEVEL, REGION

# Business lines are codes and keep their spelling; all other lists are title-cased
VERBATIM_COLUMNS = (BUSINESS_LINE,)

FILTER_COLUMNS = (REGION, BUSINESS_LINE, LEVEL)


def category_list(equipment: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of one column, sorted, as display labels.

    Labels are made after the distinct, so formatting runs once per value, and
    two values that share a label stay two rows.
    """
    values = (
        equipment.select(F.col(column).alias("category"))
        .where(F.col("category").isNotNull())
        .distinct()
        .orderBy("category")
    )
    if column in VERBATIM_COLUMNS:
        return values
    return values.select(title_label(F.col("category")).alias("category"))


def category_lists(
    equipment: DataFrame, columns: Sequence[str] = FILTER_COLUMNS
) -> DataFrame:
    """The lists of several columns from one scan: rows of (column, category)."""
    values = (
        equipment.select(*columns)
        .unpivot([], list(columns), "column_name", "category")
        .where(F.col("category").isNotNull())
        .distinct()
        .orderBy("column_name", "category")
    )
    verbatim = F.col("column_name").isin(list(VERBATIM_COLUMNS))
    label = F.when(verbatim, F.col("category")).otherwise(title_label(F.col("category")))
    return values.select("column_name", label.alias("category"))


def title_labels(equipment: DataFrame, column: str) -> DataFrame:
    """Each distinct value of a column beside its display label."""
    values = equipment.select(F.col(column).alias("value")).distinct()
    return values.withColumn("label", title_label(F.col("value")))
