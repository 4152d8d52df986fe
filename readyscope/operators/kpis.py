"""Headline KPIs. Each returns a one-row DataFrame computed in a single scan.

Only equipment columns are read, so pass the plain equipment table, or a cube of it
(``operators.cube``): the target join is not needed for a KPI.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from readyscope.functions.counting import count_where, row_count
from readyscope.functions.predicates import is_connected_not_ready, is_disconnected, is_ready
from readyscope.functions.rates import fraction, kpi_round, percent
from readyscope.operators.filters import Filters, apply_filters, filter_predicate


def total_equipment(equipment: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Row count: repeated or missing serial numbers count like any other row."""
    return apply_filters(equipment, filters).agg(row_count(equipment).alias("total_equipment"))


def ready_pct(
    equipment: DataFrame,
    filters: Filters | None = None,
    denominator: str = "fleet",
    upper_values: bool = True,
) -> DataFrame:
    """Ready rows within the filter, as a percentage with two digits.

    The default denominator is the whole fleet, not the filtered rows. For it
    the filter moves into the aggregate, so one scan gives both counts.
    """
    predicate = filter_predicate(filters, upper_values)
    if _filtered(denominator) and predicate is not None:
        equipment, predicate = equipment.where(predicate), None
    return equipment.agg(_ready_pct(equipment, predicate).alias("ready_pct"))


def ready_fraction(equipment: DataFrame) -> DataFrame:
    """Ready share of the fleet, unrounded and with two digits."""
    share = fraction(count_where(equipment, is_ready()), row_count(equipment))
    return equipment.agg(
        share.alias("ready_fraction"), kpi_round(share).alias("ready_fraction_rounded")
    )


def connected_not_ready(
    equipment: DataFrame, filters: Filters | None = None, upper_values: bool = True
) -> DataFrame:
    """Equipment that is connected with a working link but lacks services."""
    rows = apply_filters(equipment, filters, upper_values).where(is_connected_not_ready())
    return rows.agg(row_count(rows).alias("connected_not_ready"))


def disconnected(equipment: DataFrame, filters: Filters | None = None) -> DataFrame:
    rows = apply_filters(equipment, filters).where(is_disconnected())
    return rows.agg(row_count(rows).alias("disconnected"))


def kpi_panel(
    equipment: DataFrame, filters: Filters | None = None, denominator: str = "fleet"
) -> DataFrame:
    """All four KPIs in one aggregate over one scan.

    The KPIs overlap (an expired link counts as disconnected at any level), so
    they need not add up to the total.
    """
    predicate = filter_predicate(filters)
    if _filtered(denominator) and predicate is not None:
        equipment, predicate = equipment.where(predicate), None
    return equipment.agg(
        _count_within(equipment, predicate).alias("total_equipment"),
        _ready_pct(equipment, predicate).alias("ready_pct"),
        _count_within(equipment, predicate, is_connected_not_ready()).alias("connected_not_ready"),
        _count_within(equipment, predicate, is_disconnected()).alias("disconnected"),
    )


def _filtered(denominator: str) -> bool:
    if denominator not in ("fleet", "filtered"):
        raise ValueError(f"denominator must be 'fleet' or 'filtered', not {denominator!r}")
    return denominator == "filtered"


def _ready_pct(table: DataFrame, predicate: Column | None) -> Column:
    return kpi_round(percent(_count_within(table, predicate, is_ready()), row_count(table)))


def _count_within(
    table: DataFrame, predicate: Column | None, condition: Column | None = None
) -> Column:
    """Count the rows that pass both tests; a null test does not pass."""
    tests = [test for test in (predicate, condition) if test is not None]
    if not tests:
        return row_count(table)
    return count_where(table, tests[0] if len(tests) == 1 else tests[0] & tests[1])
