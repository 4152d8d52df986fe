"""Grouped reports.

Every report counts per group with map-side combine, so a group that holds a
third of the fleet costs no more than any other. Reports that need the target
count per system first and join the counts, never the rows: the join sees one
row per group and system, whatever the size of the fleet or the skew of its
system ids, and no broadcast is needed.

Each report has a total order (metric, then group columns), so equal metrics
never leave the order, or the cut of a top-k, to chance.

In place of the equipment table, every report takes a cube of it (``operators.cube``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readyscope.functions.counting import count_where, row_count
from readyscope.functions.labels import relabel
from readyscope.functions.predicates import has_problem, is_not_connected, is_ready
from readyscope.functions.rates import fraction, percent, scaled_percent
from readyscope.model import (
    BUSINESS_LINE,
    LEVEL,
    MATERIAL_ID,
    REGION,
    REGION_LABELS,
    SYSTEM_ID,
    SYSTEM_NAME,
    TARGET,
    TARGET_ATTRIBUTES,
)
from readyscope.operators.filters import Filters, apply_filters, split_filters


# Column names of the share reports, in the order total, part, rate
NOT_CONNECTED_SHARE = ("total_equipment", "srs_disconnected_equipment", "disconnected_percentage")
READY_SHARE = ("total_equipment", "srs_ready_equipment", "ready_pct")
READY_RATE = ("total_equipamentos", "equipamentos_srs_ready", "taxa_srs")
PROBLEM_RATE = ("total_equipamentos", "equipamentos_com_problema", "percentual_com_problema")


def ranked(report: DataFrame, metric: str, groups: Sequence[str], k: int | None = None) -> DataFrame:
    """Order by the metric, highest first, ties by group; with ``k``, keep the top k."""
    ordered = report.orderBy(F.desc(metric), *[F.asc(f"`{g}`") for g in groups])
    return ordered if k is None else ordered.limit(k)


def status_share(
    equipment: DataFrame,
    groups: Sequence[str],
    predicate: Column,
    names: tuple[str, str, str] = ("total", "part", "rate"),
    rate_of: Callable[[Column, Column], Column] = fraction,
    digits: int = 2,
    k: int | None = None,
) -> DataFrame:
    """Per group: row count, rows that match, and their rounded rate.

    ``names`` are the three result columns, ``rate_of`` makes the rate of the
    two counts; with ``k``, only the groups with the k highest rates.
    """
    total, part, rate = names
    counts = equipment.groupBy(*groups).agg(
        row_count(equipment).alias(total), count_where(equipment, predicate).alias(part)
    )
    report = counts.withColumn(rate, F.round(rate_of(F.col(part), F.col(total)), digits))
    return ranked(report, rate, groups, k)


def status_counts(equipment: DataFrame) -> DataFrame:
    """Row count per connection level."""
    return equipment.groupBy(LEVEL).agg(row_count(equipment).alias("equipment_count"))


def service_distribution(
    equipment: DataFrame,
    filters: Filters | None = None,
    labels: Mapping[str, str] = REGION_LABELS,
) -> DataFrame:
    """Row count per connection level and region, most frequent first.

    Regions are relabelled after counting: two regions that end up with one
    label stay two rows.
    """
    counts = (
        apply_filters(equipment, filters)
        .groupBy(LEVEL, REGION)
        .agg(row_count(equipment).alias("equipment_count"))
        .withColumn(REGION, relabel(F.col(REGION), dict(labels)))
    )
    return ranked(counts, "equipment_count", [LEVEL, REGION])


def adherence_by_business_line(
    equipment: DataFrame, targets: DataFrame, filters: Filters | None = None
) -> DataFrame:
    """Ready share per business line and target, both as whole percentages.

    A line with several targets gives one row per target, and equipment without
    a target a row of its own, which never meets it. Both sides are rounded
    before they are compared.
    """
    counts = _counts_per_target(equipment, targets, [BUSINESS_LINE], filters)
    report = counts.select(
        BUSINESS_LINE,
        F.round(F.col(TARGET) * 100).alias(TARGET),
        F.col("total").alias("total_count"),
        F.col("ready").alias("srs_ready_count"),
        F.round(percent(F.col("ready"), F.col("total"))).alias("adherence_pct"),
    ).withColumn("meets_target", _meets("adherence_pct", TARGET))
    return ranked(report, "adherence_pct", [BUSINESS_LINE, TARGET])


def adherence_by_system(
    equipment: DataFrame,
    targets: DataFrame,
    filters: Filters | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Unrounded ready share per system beside its target; 1 where the target is reached.

    With ``names``, a table of one name per system, rows are counted by id alone and the
    names joined to the counts; otherwise equipment has them.
    """
    groups = [SYSTEM_ID, SYSTEM_NAME]
    if names is None:
        counts = _counts_per_target(equipment, targets, groups, filters)
    else:
        counts = _counts_per_target(equipment, targets, [SYSTEM_ID], filters)
        counts = counts.join(names, SYSTEM_ID, "left")
    report = counts.select(
        *groups,
        F.col("total").alias("total_equipment"),
        F.col("ready").alias("srs_ready_equipment"),
        percent(F.col("ready"), F.col("total")).alias("srs_ready_pct_display"),
        (F.col(TARGET) * 100).alias("target_srs_ready_pct"),
    ).withColumn("on_target", _meets("srs_ready_pct_display", "target_srs_ready_pct").cast("int"))
    return ranked(report, "srs_ready_pct_display", [*groups, "target_srs_ready_pct"])


def _meets(actual: str, target: str) -> Column:
    """Whether a rate reaches its target; nothing reaches a target that is not there."""
    return F.coalesce(F.col(actual) >= F.col(target), F.lit(False))


def not_connected_by_system(equipment: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Not-connected share per system; for ``names`` see ``adherence_by_system``."""
    groups = [SYSTEM_ID, SYSTEM_NAME]
    if names is None:
        return status_share(equipment, groups, is_not_connected(), NOT_CONNECTED_SHARE)
    shares = status_share(equipment, [SYSTEM_ID], is_not_connected(), NOT_CONNECTED_SHARE)
    named = shares.join(names, SYSTEM_ID, "left")
    return ranked(named.select(*groups, *NOT_CONNECTED_SHARE), NOT_CONNECTED_SHARE[2], groups)


def counts_by_target(equipment: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows per target: total, ready and problems. Counts are joined, not rows."""
    return _counts_per_target(equipment, targets, [], None)


def not_connected_by_business_line(equipment: DataFrame) -> DataFrame:
    return status_share(equipment, [BUSINESS_LINE], is_not_connected(), NOT_CONNECTED_SHARE)


def ready_share_by_business_line(equipment: DataFrame) -> DataFrame:
    return status_share(equipment, [BUSINESS_LINE], is_ready(), READY_SHARE)


def top_regions_by_ready_rate(equipment: DataFrame, k: int = 1) -> DataFrame:
    """The regions with the highest ready rate."""
    return status_share(equipment, [REGION], is_ready(), READY_RATE, scaled_percent, k=k)


def problem_share_by_business_line(equipment: DataFrame, k: int = 10) -> DataFrame:
    """The business lines with the highest share of equipment that is not ready."""
    groups = [BUSINESS_LINE]
    return status_share(equipment, groups, has_problem(), PROBLEM_RATE, scaled_percent, k=k)


def _counts_per_target(
    equipment: DataFrame,
    targets: DataFrame,
    groups: Sequence[str],
    filters: Filters | None,
) -> DataFrame:
    """Total, ready and problem rows per group and target.

    Rows are counted per group and system before the join. That equals joining
    the rows first: each row of a group meets the same targets, also where a
    material is listed twice. Filters on target columns apply after the join.
    """
    target_filters, row_filters = split_filters(filters, TARGET_ATTRIBUTES)
    counts = (
        apply_filters(equipment, row_filters)
        .groupBy(*dict.fromkeys([*groups, SYSTEM_ID]))
        .agg(
            row_count(equipment).alias("total"),
            count_where(equipment, is_ready()).alias("ready"),
            count_where(equipment, has_problem()).alias("problems"),
        )
    )
    wanted = dict.fromkeys([MATERIAL_ID, TARGET, *target_filters])
    dimension = targets.select(*[F.col(f"`{name}`") for name in wanted])
    joined = counts.join(dimension, counts[SYSTEM_ID] == dimension[MATERIAL_ID], "left")
    return (
        apply_filters(joined, target_filters)
        .groupBy(*groups, TARGET)
        .agg(*[F.sum(c).alias(c) for c in ("total", "ready", "problems")])
    )
