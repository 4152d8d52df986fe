"""Row predicates over equipment. Comparisons with null stay null, so they never match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readyscope.model import (
    CONNECTED_NOT_READY,
    LEVEL,
    LINK_EXPIRED_PREFIX,
    LINK_OK,
    LINK_STATUS,
    NOT_CONNECTED,
    READY,
)


def is_ready() -> Column:
    return F.col(LEVEL) == READY


def is_not_connected() -> Column:
    return F.col(LEVEL) == NOT_CONNECTED


def is_connected_not_ready(require_link_ok: bool = True) -> Column:
    """Connected with services missing. The KPI wants a working link, the action list does not."""
    level = F.col(LEVEL) == CONNECTED_NOT_READY
    return level & (F.col(LINK_STATUS) == LINK_OK) if require_link_ok else level


def is_disconnected() -> Column:
    """Not connected, or an expired link at any level (so it may overlap the other KPIs)."""
    return is_not_connected() | F.col(LINK_STATUS).startswith(LINK_EXPIRED_PREFIX)


def has_problem() -> Column:
    """Any known level other than ready; an unknown (null) level is not a problem."""
    return F.col(LEVEL) != READY
