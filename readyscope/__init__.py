"""Connectivity readiness of an equipment fleet, as Spark DataFrame operators."""

from readyscope.operators.action_list import activation_list
from readyscope.operators.categories import category_list, category_lists, title_labels
from readyscope.operators.enrich import enrich, profile_targets
from readyscope.operators.filters import apply_filters, filter_predicate, selections_to_filters
from readyscope.operators.kpis import (
    connected_not_ready,
    disconnected,
    kpi_panel,
    ready_fraction,
    ready_pct,
    total_equipment,
)
from readyscope.operators.rollups import (
    adherence_by_business_line,
    adherence_by_system,
    not_connected_by_business_line,
    not_connected_by_system,
    problem_share_by_business_line,
    ready_share_by_business_line,
    service_distribution,
    status_counts,
    status_share,
    top_regions_by_ready_rate,
)
from readyscope.operators.summary import describe_table
from readyscope.plans.board import ReadinessBoard
from readyscope.plans.metrics import metric_by
from readyscope.plans.sqlgate import SqlGate
from readyscope.sources.extracts import load_fleet, read_extract, to_parquet, write_extract
from readyscope.sources.reports import export_month, read_months

__all__ = [
    "ReadinessBoard",
    "SqlGate",
    "activation_list",
    "adherence_by_business_line",
    "adherence_by_system",
    "apply_filters",
    "category_list",
    "category_lists",
    "connected_not_ready",
    "describe_table",
    "disconnected",
    "enrich",
    "export_month",
    "filter_predicate",
    "kpi_panel",
    "load_fleet",
    "metric_by",
    "not_connected_by_business_line",
    "not_connected_by_system",
    "problem_share_by_business_line",
    "profile_targets",
    "read_extract",
    "read_months",
    "ready_fraction",
    "ready_pct",
    "ready_share_by_business_line",
    "selections_to_filters",
    "service_distribution",
    "status_counts",
    "status_share",
    "title_labels",
    "to_parquet",
    "top_regions_by_ready_rate",
    "total_equipment",
    "write_extract",
]
