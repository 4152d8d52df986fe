"""Named metrics and dimensions, with the business terms that stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readyscope.functions.counting import count_where, row_count
from readyscope.functions.predicates import has_problem, is_ready
from readyscope.functions.rates import scaled_percent
from readyscope.model import BUSINESS_LINE, CITY, REGION, STATE, TARGET
from readyscope.operators.rollups import counts_by_target, ranked

DIMENSIONS = {
    "region": REGION,
    "business_line": BUSINESS_LINE,
    "state": STATE,
    "city": CITY,
    "target": TARGET,
}

# Business terms of the executive reports
TERMS = {
    "ready": [
        "SRS", "SRS READY", "conectividade SRS", "conectado ao SRS", "readiness SRS",
    ],
    "ready_rate": [
        "taxa de conectividade SRS", "percentual SRS", "taxa SRS", "adherence SRS",
        "aderência SRS",
    ],
    "problems": [
        "problemas de conectividade SRS", "problemas SRS", "não conectados ao SRS",
        "fora do SRS", "não SRS READY",
    ],
    "region": ["região", "região do Brasil", "regional"],
    "business_line": ["linha de equipamento", "linha", "linha de negócio", "business line"],
    "state": ["estado"],
    "city": ["cidade"],
    "target": ["meta SRS", "target SRS", "objetivo SRS"],
}

_NAME_OF_TERM = {term.lower(): name for name, terms in TERMS.items() for term in terms}


def _metrics(table: DataFrame | None) -> dict[str, Column]:
    if table is None:
        total, ready, problems = F.count("*"), F.count_if(is_ready()), F.count_if(has_problem())
    else:
        total = row_count(table)
        ready, problems = count_where(table, is_ready()), count_where(table, has_problem())
    return {
        "total": total,
        "ready": ready,
        "ready_rate": F.round(scaled_percent(ready, total), 2),
        "problems": problems,
        "problem_rate": F.round(scaled_percent(problems, total), 2),
    }


METRICS = ("total", "ready", "ready_rate", "problems", "problem_rate")


def registered_name(name_or_term: str) -> str:
    """The registered name that a business term stands for; names stand for themselves."""
    return _NAME_OF_TERM.get(name_or_term.strip().lower(), name_or_term)


def metric(name_or_term: str, table: DataFrame | None = None) -> Column:
    """The aggregate expression of a metric, on rows or on what ``table`` is, rows or a cube."""
    name = registered_name(name_or_term)
    if name not in METRICS:
        raise KeyError(f"unknown metric {name_or_term!r}; known: {', '.join(METRICS)}")
    return _metrics(table)[name]


def dimension(name_or_term: str) -> str:
    """The column of a dimension."""
    name = registered_name(name_or_term)
    if name not in DIMENSIONS:
        raise KeyError(f"unknown dimension {name_or_term!r}; known: {', '.join(DIMENSIONS)}")
    return DIMENSIONS[name]


def metric_by(
    fleet: DataFrame,
    metric_name: str,
    dimension_name: str,
    k: int | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """One metric per value of one dimension, highest first; with ``k``, the top k.

    By target, ``fleet`` may be plain equipment if ``targets`` are given: rows are then
    counted per system, and the counts joined to the targets.
    """
    name, column = registered_name(metric_name), dimension(dimension_name)
    if targets is not None and column == TARGET:
        metric(name)  # known, or an error
        counts = counts_by_target(fleet, targets)
        part = {"ready_rate": "ready", "problem_rate": "problems"}.get(name)
        value = F.round(scaled_percent(F.col(part), F.col("total")), 2) if part else F.col(name)
        return ranked(counts.select(column, value.alias(name)), name, [column], k)
    report = fleet.groupBy(column).agg(metric(name, fleet).alias(name))
    return ranked(report, name, [column], k)
