"""Rate expressions. Division by an empty total gives null instead of an error.

Two roundings occur on purpose. Rates that the dashboard shows as one number
round like Python's ``round``; rates that are columns of a report round half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction(part: Column, total: Column) -> Column:
    return F.try_divide(part, total)


def percent(part: Column, total: Column) -> Column:
    """``part / total * 100``, unrounded, in this order of operations."""
    return fraction(part, total) * 100


def scaled_percent(part: Column, total: Column) -> Column:
    """``part * 100.0 / total``: the SQL templates' order, which rounds differently at times."""
    return F.try_divide(part * F.lit(100.0), total)


def kpi_round(rate: Column, digits: int = 2) -> Column:
    """Round the binary value of a double, exact ties to even, like Python's ``round``.

    The scaled rate may look like a tie where the true product is a little more or less.
    The two halves of the rate's digits times the scale are exact, so their difference to
    the rounded product is the error that decides.
    """
    scale = float(10**digits)
    scaled = rate * scale
    spread = rate * F.lit(134_217_729.0)  # 2^27 + 1 parts the 53 digits in two
    high = spread - (spread - rate)
    error = (high * scale - scaled) + (rate - high) * scale
    below = F.floor(scaled).cast("double")
    tie = (scaled - below == 0.5) & (error != 0)
    nearest = F.when(tie, F.when(error > 0, below + 1).otherwise(below)).otherwise(F.rint(scaled))
    return nearest / scale
