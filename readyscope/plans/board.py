"""The dashboard's queries on one fleet, with plain Python values where it shows one."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from readyscope.operators import action_list, categories, enrich, kpis, rollups
from readyscope.operators.filters import Filters
from readyscope.plans.sqlgate import SqlGate
from readyscope.sources.extracts import load_fleet
from readyscope.sources.reports import export_month


class ReadinessBoard:
    """Equipment and targets, joined only where a query needs both."""

    def __init__(self, equipment: DataFrame, targets: DataFrame):
        self.equipment = equipment
        self.targets = targets

    @classmethod
    def load(
        cls, spark: SparkSession, equipment_path: str, targets_path: str, fmt: str = "csv"
    ) -> ReadinessBoard:
        return cls(*load_fleet(spark, equipment_path, targets_path, fmt))

    @cached_property
    def fleet(self) -> DataFrame:
        """The enriched rows."""
        return enrich.enrich(self.equipment, self.targets)

    @cached_property
    def _gate(self) -> SqlGate:
        return SqlGate(self.fleet)

    def total_equipment(self, filters: Filters | None = None) -> int:
        return kpis.total_equipment(self._rows(filters), filters).first()[0]

    def ready_pct(self, filters: Filters | None = None) -> float | None:
        return kpis.ready_pct(self._rows(filters), filters).first()[0]

    def connected_not_ready(self, filters: Filters | None = None) -> int:
        return kpis.connected_not_ready(self._rows(filters), filters).first()[0]

    def disconnected(self, filters: Filters | None = None) -> int:
        return kpis.disconnected(self._rows(filters), filters).first()[0]

    def kpis(self, filters: Filters | None = None) -> dict[str, int | float | None]:
        """All four in one job."""
        return kpis.kpi_panel(self._rows(filters), filters).first().asDict()

    def choices(self, column: str) -> list[str]:
        """The whole filter list of a column; for long ones see ``category_list``."""
        rows = categories.category_list(self._rows({column: []}), column)
        return [row["category"] for row in rows.toLocalIterator()]

    def service_distribution(self, filters: Filters | None = None) -> DataFrame:
        return rollups.service_distribution(self._rows(filters), filters)

    def adherence_by_business_line(self, filters: Filters | None = None) -> DataFrame:
        return rollups.adherence_by_business_line(self.equipment, self.targets, filters)

    def adherence_by_system(self, filters: Filters | None = None) -> DataFrame:
        return rollups.adherence_by_system(self.equipment, self.targets, filters)

    def activation_list(self, filters: Filters | None = None) -> DataFrame:
        return action_list.activation_list(self._rows(filters), filters)

    def export_activation_list(self, base_path: str, month: str | None = None) -> str:
        """Write the month's list, unfiltered."""
        return export_month(self.activation_list(), base_path, month)

    def sql(self, query: str) -> str:
        return self._gate.answer(query)

    def _rows(self, filters: Filters | None) -> DataFrame:
        """Equipment, joined to its targets only when a filter is on a target column."""
        on_equipment = set(filters or {}) <= set(self.equipment.columns)
        return self.equipment if on_equipment else self.fleet
