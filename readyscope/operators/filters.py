"""Multi-select filters: a dict of column -> allowed values, as one predicate."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readyscope.model import ALL_TOKENS

# Values of a filter that a plan carries as they are; more of them become a table
LONGEST_LIST = 1000
# A value table of more characters than this is not broadcast
BROADCAST_CHARACTERS = 16 * 1024 * 1024
_VALUE = "value of a filter"

Filters = Mapping[str, "str | Sequence[str]"]


def selections_to_filters(
    selections: Filters, all_tokens: Mapping[str, str] = ALL_TOKENS
) -> dict[str, list[str]]:
    """Turn list selections into a filter dict.

    A column whose selection holds its "everything" entry is not filtered at
    all, even when other values are selected beside it.
    """
    chosen = {column: _as_list(values) for column, values in selections.items()}
    return {
        column: values
        for column, values in chosen.items()
        if values and all_tokens.get(column) not in values
    }


def filter_predicate(filters: Filters | None, upper_values: bool = True) -> Column | None:
    """One conjunction of ``IN`` tests, or None when nothing is filtered.

    The requested values are upper-cased, the column never is. An empty value
    list means "no filter on this column".
    """
    tests = []
    for column, values in (filters or {}).items():
        wanted = _as_list(values)
        if not wanted:
            continue
        if upper_values:
            wanted = [v.upper() if isinstance(v, str) else v for v in wanted]
        tests.append(F.col(_quoted(column)).isin(wanted))
    return reduce(lambda left, right: left & right, tests) if tests else None


def apply_filters(
    df: DataFrame, filters: Filters | None, upper_values: bool = True
) -> DataFrame:
    """The rows that pass every filter.

    A text column's list of more than ``LONGEST_LIST`` values becomes a table of distinct
    values that the rows are semi-joined with: by broadcast while it is small, else by
    shuffle. As with ``IN``, a null matches nothing.
    """
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    long = {
        column: _as_list(values) for column, values in (filters or {}).items()
        if column in texts and _is_long(_as_list(values))
    }
    predicate = filter_predicate({c: v for c, v in (filters or {}).items() if c not in long}, upper_values)
    kept = df if predicate is None else df.where(predicate)
    for column, values in long.items():
        wanted = sorted({v.upper() if upper_values else v for v in values if v is not None})
        table = df.sparkSession.createDataFrame([(v,) for v in wanted], T.StructType([T.StructField(_VALUE, T.StringType())]))
        if sum(map(len, wanted)) <= BROADCAST_CHARACTERS:
            table = F.broadcast(table)
        kept = kept.join(table, F.col(_quoted(column)) == F.col(f"`{_VALUE}`"), "left_semi")
    return kept


def _is_long(values: list) -> bool:
    return len(values) > LONGEST_LIST and all(v is None or isinstance(v, str) for v in values)


def split_filters(filters: Filters | None, columns: Iterable[str]) -> tuple[dict, dict]:
    """Split a filter dict into the part on ``columns`` and the rest."""
    names = set(columns)
    entries = dict(filters or {})
    return (
        {c: v for c, v in entries.items() if c in names},
        {c: v for c, v in entries.items() if c not in names},
    )


def _as_list(values) -> list:
    if values is None:
        return []
    return [values] if isinstance(values, str) else list(values)


def _quoted(column: str) -> str:
    """Plain dotted names are paths into a struct; all others are taken as they are."""
    if re.fullmatch(r"\w+(\.\w+)+", column):
        return column
    return "`{}`".format(column.replace("`", "``"))
