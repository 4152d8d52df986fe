"""Equipment to activate: connected, but services are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readyscope.functions.predicates import is_connected_not_ready
from readyscope.model import (
    BUSINESS_LINE,
    CITY,
    LINK_STATUS,
    REGION,
    SERIAL,
    STATE,
    SYSTEM_NAME,
)
from readyscope.operators.filters import Filters, apply_filters


# Column titles of the report
TITLES = {
    SERIAL: "Serial Number",
    SYSTEM_NAME: "System",
    BUSINESS_LINE: "Business Line",
    "place": "City/State",
    REGION: "Service Region",
    LINK_STATUS: "Status",
}


def activation_list(
    equipment: DataFrame, filters: Filters | None = None, require_link_ok: bool = False
) -> DataFrame:
    """One row per equipment to activate, under the report's column titles.

    Unlike the KPI, the list also holds equipment whose link is down, unless
    ``require_link_ok`` is set. The place is null when city or state is missing.
    No shuffle: a filter and a projection on the scan.
    """
    rows = apply_filters(equipment, filters).where(is_connected_not_ready(require_link_ok))
    place = F.concat(F.col(CITY), F.lit("/"), F.col(STATE))
    return rows.withColumn("place", place).select(
        *[F.col(column).alias(title) for column, title in TITLES.items()]
    )
