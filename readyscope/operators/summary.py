"""Summary statistics of every column, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATISTICS = ("count", "mean", "stddev", "min", "max")

# How a text must start to be a number; anything else is not even tried. A failed
# parse raises inside the cast, which is costly when whole columns are words. The
# first character rules most words out before the pattern runs: blanks, signs,
# points and digits lie below 58; 127 is a control character, the rest are I N i n.
_NUMBER_START = r"(?i)^[\s\p{Cntrl}]*[+-]?(\d|\.\d|inf|nan)"
_FIRST_CHARACTER = "ascii({0}) < 58 OR ascii({0}) IN (73, 78, 105, 110, 127)"


def describe_table(df: DataFrame) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum, as ``df.describe()`` shows them.

    Covers number and text columns; mean and deviation of a text column are
    over those values that are numbers.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))]
    if not fields:
        return df.describe()
    names = [_quoted(field.name) for field in fields]
    # the number in a text is parsed once, below the aggregates that share it
    parsed = [f"{_number(field)} AS {_number_name(i)}" for i, field in enumerate(fields)]
    measured = df.selectExpr(*names, *parsed).agg(
        *[
            F.expr(f"array({', '.join(_statistics(names[i], _number_name(i)))}) AS {names[i]}")
            for i in range(len(fields))
        ]
    )
    rows = [
        f"struct('{statistic}' AS summary, {', '.join(f'{n}[{i}] AS {n}' for n in names)})"
        for i, statistic in enumerate(STATISTICS)
    ]
    return measured.selectExpr(f"inline(array({', '.join(rows)}))")


def _number_name(i: int) -> str:
    return _quoted(f"number of column {i}")


def _number(field: T.StructField) -> str:
    values = _quoted(field.name)
    if not isinstance(field.dataType, T.StringType):
        return values
    number_like = f"({_FIRST_CHARACTER.format(values)}) AND {values} RLIKE r'{_NUMBER_START}'"
    return f"try_cast(CASE WHEN {number_like} THEN {values} END AS DOUBLE)"


def _statistics(values: str, numbers: str) -> list[str]:
    """The aggregates of one column as SQL text, in the order of STATISTICS."""
    aggregates = [
        f"count({values})", f"avg({numbers})", f"stddev({numbers})", f"min({values})", f"max({values})"
    ]
    return [f"string({aggregate})" for aggregate in aggregates]


def _quoted(name: str) -> str:
    return "`{}`".format(name.replace("`", "``"))
